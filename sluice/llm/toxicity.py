"""A counterfactual-regularised toxicity classifier.

A linear model over the words of a text and their first letters is fitted on a bounded sample of
labelled documents.  For each labelled document the identity terms of its language are swapped for their counterparts;
a penalty on the squared change of the score holds the model to what does not depend on the group that is
named, so that a neutral mention of a group does not count against a text.  Identity terms and their counterparts are
features whether or not they tell labels apart.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

#: By language: identity terms and what they are swapped with, both ways.
IDENTITY_SWAPS = {
    "en": {
        "women": "men", "woman": "man", "girls": "boys", "girl": "boy", "female": "male", "she": "he", "her": "his", "mothers": "fathers", "mother": "father", "daughter": "son",
        "muslim": "christian", "muslims": "christians", "jewish": "buddhist", "jews": "buddhists", "black": "white", "gay": "straight", "lesbian": "heterosexual", "transgender": "cisgender",
        "asian": "european", "african": "american", "immigrant": "citizen", "immigrants": "citizens", "foreign": "local", "old": "young", "disabled": "able", "deaf": "hearing",
    },
    "de": {"frauen": "männer", "frau": "mann", "mädchen": "jungen", "ausländer": "inländer", "muslime": "christen", "juden": "buddhisten", "schwarze": "weiße", "sie": "er", "mutter": "vater", "tochter": "sohn"},
    "fr": {"femmes": "hommes", "femme": "homme", "filles": "garçons", "étrangers": "français", "musulmans": "chrétiens", "juifs": "bouddhistes", "noirs": "blancs", "elle": "il", "mère": "père", "fille": "fils"},
    "es": {"mujeres": "hombres", "mujer": "hombre", "chicas": "chicos", "extranjeros": "españoles", "musulmanes": "cristianos", "judíos": "budistas", "negros": "blancos", "ella": "él", "madre": "padre", "hija": "hijo"},
}
#: Words by which a text's language is told.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "this", "are", "from", "by"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "für", "auf", "ist", "nicht", "dem", "eine", "ein", "im"],
    "fr": ["le", "et", "les", "des", "du", "une", "est", "pour", "dans", "qui", "au", "par", "sur", "pas", "avec"],
    "es": ["el", "y", "los", "se", "del", "las", "por", "con", "para", "una", "no", "su", "al", "lo"],
}
#: The fit takes at most so many labelled rows, one for each doc_id, those whose hashed ids come first.
TRAIN_ROWS = 8000
FEATURES = 6000
PENALTY = 50.0
LEAST_Z = 4.5
PREFIXES = (4, 5, 6)
_STRIP = b".,!?;:\"'()[]{}*&%$#-_"


def features(text: str, cache: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Distinct 63-bit hashes of the words and of their first letters."""
    got: set[int] = set()
    for raw in set(text.lower().encode("utf-8", "surrogatepass").split()):
        h = cache.get(raw)
        if h is None:
            word = raw.strip(_STRIP)
            s = word.decode("utf-8", "replace")
            h = tuple(x >> 1 for x in [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(s[:k].encode(), seed=k) for k in PREFIXES if len(s) > k)]) if word else ()
            if len(cache) >= 80_000:
                cache.clear()
            cache[raw] = h
        got.update(h)
    return np.fromiter(got, np.int64, len(got))


def language(text: str) -> str | None:
    """The language whose function words the text has most of; none if it has none."""
    found = text.lower().split()
    counts = {name: sum(map(held.__contains__, found)) for name, held in ((n, frozenset(w)) for n, w in FUNCTION_WORDS.items())}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def swapped(text: str, swaps: dict[str, str]) -> str:
    """The text with each identity term replaced by its counterpart (words at white space, punctuation kept)."""
    strip = _STRIP.decode()
    out = []
    for token in text.lower().split():
        core = token.strip(strip)
        out.append(token.replace(core, swaps[core]) if core in swaps else token)
    return " ".join(out)


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, width: int, changes: list[np.ndarray], l2: float = 2.0, penalty: float = PENALTY, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the bias; minimises log loss + l2 |w|^2 / 2 + penalty * sum of squared score changes.

    ``rows`` has feature numbers; ``changes`` has signed ones: n + 1 for a feature that a swap adds, -(n + 1) for one that it removes.
    """

    def csr(lists):
        sizes = np.array([len(x) for x in lists], np.int64)
        return (np.concatenate(lists) if sizes.sum() else np.zeros(0, np.int64)), np.repeat(np.arange(len(lists)), sizes)

    cols, at = csr(rows)
    moved, mat = csr(changes)
    sign, moved = np.sign(moved).astype(float), np.abs(moved) - 1
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, v, b, bv = np.zeros(width), np.zeros(width), 0.0, 0.0
    per = np.bincount(cols, weights=weight[at], minlength=width) / 4 * 8 + l2 + penalty * np.bincount(moved, minlength=width) * 2
    for _ in range(rounds):
        s = np.bincount(at, weights=w[cols], minlength=len(rows)) + b
        r = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) * weight
        d = np.bincount(mat, weights=sign * w[moved], minlength=len(changes)) if len(changes) else np.zeros(0)
        g = np.bincount(cols, weights=r[at], minlength=width) + l2 * w
        if len(changes):
            g += 2 * penalty * np.bincount(moved, weights=sign * d[mat], minlength=width)
        v = 0.9 * v - 0.3 * g / per
        bv = 0.9 * bv - 0.3 * r.sum() / (weight.sum() * 2)
        w, b = w + v, b + bv
    return np.append(w, b)


def train(docs: DataFrame, labels: DataFrame, swaps: dict[str, dict[str, str]] | None = None, most: int = TRAIN_ROWS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights with the bias last), learned from labelled rows whose crc32(doc_id) mod 3 is not 1, at most one text of each
    of ``most`` doc_ids (see ``common.labelled``).  Without labels of both kinds all weights but the bias are 0.

    A text's language is told from its words; one without a function word takes the swaps of all languages.
    """
    swaps = IDENTITY_SWAPS if swaps is None else swaps
    both_ways = {name: held | {b: a for a, b in held.items()} for name, held in swaps.items()}
    both_ways[None] = {a: b for held in both_ways.values() for a, b in held.items()}

    def run(batches):
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            a = [features(t, cache) for t in batch.column(2).to_pylist()]
            b = []
            for t, x in zip(batch.column(2).to_pylist(), a):
                z = features(swapped(t, both_ways.get(language(t), {})), cache)
                b.append(np.concatenate([np.setdiff1d(z, x), ~np.setdiff1d(x, z)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], ["doc_id", "key", "y", "x", "change"])

    rows = common.labelled(docs, labels, "toxic", common.bucket_of(F.col("doc_id"), 3) == 1, most)
    got = common.one_each(rows.mapInArrow(common.tidied(run), "doc_id long, key long, y int, x binary, change binary"), ["y", "x", "change"])
    y = np.array(got["y"].to_pylist(), float)
    rows = [np.frombuffer(x, np.int64) for x in got["x"].to_pylist()]
    changes = [np.frombuffer(x, np.int64) for x in got["change"].to_pylist()]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(0, np.int64), np.array([np.log(rate / (1 - rate))])
    every, code = np.unique(np.concatenate(rows), return_inverse=True)
    mine = np.repeat(y, [len(x) for x in rows])
    pos = np.bincount(code, weights=mine, minlength=len(every))
    neg = np.bincount(code, minlength=len(every)) - pos
    p, q = pos / y.sum(), neg / (len(y) - y.sum())
    rate = (pos + neg) / len(y)
    gain = np.abs(p - q) / np.sqrt(rate * (1 - rate) * (1 / y.sum() + 1 / (len(y) - y.sum())) + 1e-12)
    # words that differ by more than the chance among so many words explains
    order = np.argsort(-np.where(pos + neg >= 3, gain, -1), kind="stable")[:FEATURES]
    chosen = every[order[: max(20, int((gain[order] >= LEAST_Z).sum()))]]
    # all identity terms that occur, and what they are swapped with
    terms = np.array([xxhash.xxh3_64_intdigest(w.encode()) >> 1 for w in both_ways[None]], np.int64)
    seen = np.concatenate([every, *[np.where(c < 0, ~c, c) for c in changes]])
    chosen = np.union1d(chosen, terms[np.isin(terms, seen)])

    def numbers(x: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)
        return i[chosen[i] == x]

    moved = [np.concatenate([numbers(c[c >= 0]) + 1, -(numbers(~c[c < 0]) + 1)]) for c in changes]
    return chosen, fit_logistic([numbers(x) for x in rows], y, len(chosen), [m for m in moved if len(m)], penalty=penalty)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "__toxicity") -> DataFrame:
    """``docs`` with one more column (__toxicity, if not another name is given): 0 to 1.  All other columns stay; a null text is an empty one.

    The model has at most FEATURES weights and travels with the tasks.
    """
    chosen, weights = model
    table = dict(zip(chosen.tolist(), weights[:-1].tolist()))
    bias = float(weights[-1])

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[bytes, float] = {}
        hashes: dict = {}
        for series in batches:
            out = []
            for text in series:
                seen, s = set(), bias
                for raw in set((text or "").lower().encode("utf-8", "surrogatepass").split()):
                    got = cache.get(raw)
                    if got is None:
                        got = tuple((h, table[h]) for h in features(raw.decode("utf-8", "surrogatepass"), hashes).tolist() if h in table)
                        if len(cache) >= 100_000:
                            cache.clear()
                        cache[raw] = got
                    for h, w in got:
                        if h not in seen:
                            seen.add(h)
                            s += w
                out.append(1 / (1 + np.exp(-max(-40.0, min(40.0, s)))))
            yield pd.Series(out, dtype="float64")
        cache.clear()
        hashes.clear()
        common.tidy()

    return docs.withColumn(column, F.pandas_udf(scored, "double")(F.col("text").cast("string")))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every whole text; see ``train`` and ``score``.

    A row with a null doc_id is scored and is not held out; repeated rows get equal scores; no rows give none.
    """
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = score(common.texts(docs), model)
    held = F.coalesce(common.bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.7).cast("int").alias("predicted"))
