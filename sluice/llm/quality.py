"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features are measures of the line and of the lines before and
after it; the chain adds transitions.  Forward-backward marginals, weighted by the lines' lengths, give the
good share of a document, which a logistic curve turns into the score.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

#: The fit takes at most so many labelled rows, one for each doc_id, those whose hashed ids come first.
TRAIN_ROWS = 4000
_UPPER = bytes(range(65, 91))
_SYMBOL = b"!#$%&*@^~|<>{}[]=_\\/+"
_DIGIT = bytes(range(48, 58))
OWN = 11


def measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line that is not blank (at least one line) and the lines' lengths in bytes."""
    out, sizes, seen, before = [], [], set(), b""
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = max(1, n - k + 1)
        short = min(k, 12)
        lower = line.lower()
        out.append((
            (n - len(line.translate(None, _UPPER))) / letters,
            min(1.0, 3 * (n - len(line.translate(None, _SYMBOL))) / letters),
            (n - len(line.translate(None, _DIGIT))) / letters,
            1 - len(set(words)) / k,
            sum(map(bytes.__eq__, words[1:], words)) / k,
            sum(w in (b"|", b"-", b"*", b">") for w in words) / k,
            min(2.0, letters / k / 8),
            short / 12,
            float(line.rstrip()[-1:] in (b".", b"!", b"?")),
            float(lower in seen),
            float(before == lower),
        ))
        seen.add(lower)
        before = lower
        sizes.append(n)
    if not out:
        return np.zeros((1, OWN)), np.ones(1)
    return np.array(out), np.array(sizes, float)


def with_neighbours(m: np.ndarray) -> np.ndarray:
    """A constant, each line's measures, their squares, and those of the lines before and after."""
    zero = np.zeros((1, m.shape[1]))
    return np.hstack([np.ones((len(m), 1)), m, m * m, np.vstack([zero, m[:-1]]), np.vstack([m[1:], zero])])


def marginals(emit: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per sequence the probability that each line is bad, and the expected transitions of all, by forward-backward.

    ``emit`` has the score of bad against good; sequences of like length run together.
    """
    out: list = [None] * len(emit)
    pairs = np.zeros((2, 2))
    groups: dict[int, list[int]] = {}
    for i, e in enumerate(emit):
        groups.setdefault((len(e) - 1).bit_length(), []).append(i)
    psi = np.exp(trans)
    for ids in groups.values():
        t = max(len(emit[i]) for i in ids)
        e = np.ones((len(ids), t, 2))
        mask = np.zeros((len(ids), t), bool)
        for r, i in enumerate(ids):
            e[r, : len(emit[i]), 1] = np.exp(np.clip(emit[i], -30, 30))
            mask[r, : len(emit[i])] = True
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        alpha[:, 0] = a
        for k in range(1, t):
            a = (a @ psi) * e[:, k]
            a /= a.sum(1, keepdims=True)
            alpha[:, k] = a
        b = np.ones((len(ids), 2))
        for k in range(t - 2, -1, -1):
            b = np.where(mask[:, k + 1, None], (b * e[:, k + 1]) @ psi.T, 1.0)
            b /= b.sum(1, keepdims=True)
            beta[:, k] = b
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        for r, i in enumerate(ids):
            out[i] = both[r, : len(emit[i]), 1]
        if t > 1:
            joint = alpha[:, :-1, :, None] * psi * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            joint /= joint.sum((2, 3), keepdims=True)
            pairs += joint[mask[:, 1:]].sum(0)
    return out, pairs


def fit(rows: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray) -> dict:
    """Weights of emissions and transitions, and the curve from a document's good share to its score.

    Only documents have labels: lines of bad documents begin as bad, those that look good to the model of the
    round before become good (the worst line of a bad document stays bad), lines of good documents are good.
    """
    feats = [with_neighbours(m) for m in rows]
    x, at = np.vstack(feats), np.cumsum([0, *map(len, feats)])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    bad = np.repeat(1.0 - y, np.diff(at))
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    starts = np.ones(len(x), bool)
    starts[at[:-1]] = False
    inner = np.flatnonzero(starts)
    doc_weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    each = np.repeat(doc_weight / np.diff(at), np.diff(at))
    for relabel in range(3):
        for step in range(120):  # pointwise
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 2.0 * ((x * ((p - bad) * each)[:, None]).sum(0) / len(y) + 0.002 * w)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        for d in np.flatnonzero(y == 0):
            own = p[at[d] : at[d + 1]]
            lab = (own >= 0.5).astype(float)
            lab[np.argmax(own)] = 1
            bad[at[d] : at[d + 1]] = lab
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[inner - 1].astype(int), bad[inner].astype(int)), 1)
    for step in range(60):  # the chain: conditional likelihood by forward-backward
        e = x @ w
        got, pairs = marginals([e[at[d] : at[d + 1]] for d in range(len(y))], trans)
        w -= 1.0 * ((x * ((np.concatenate(got) - bad) * each)[:, None]).sum(0) / len(y) + 0.002 * w)
        trans += 2.0 * ((seen - pairs) / max(1, len(inner)) - 0.01 * trans)
    model = {"mean": mean, "scale": scale, "w": w, "trans": trans}
    share = good_share(rows, sizes, model)
    z = np.log((share + 0.01) / (1.01 - share))
    a, c = 1.0, 0.0
    for step in range(500):
        r = 1 / (1 + np.exp(-(a * z + c))) - y
        a, c = a - 0.5 * ((r * z * doc_weight).mean() / 4 + 0.001 * a), c - 0.5 * (r * doc_weight).mean()
    return model | {"a": max(a, 0.1), "c": c}


def good_share(rows: list[np.ndarray], sizes: list[np.ndarray], model: dict) -> np.ndarray:
    feats = [(with_neighbours(m) - model["mean"]) / model["scale"] for m in rows]
    got, _ = marginals([f @ model["w"] for f in feats], model["trans"])
    return np.array([1 - float((p * s).sum() / s.sum()) for p, s in zip(got, sizes)])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, at most one text of each of ``most`` doc_ids (see
    ``common.labelled``); only line measures come to the driver."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [measures(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([m.astype(np.float32).tobytes() for m, _ in got], pa.binary()), pa.array([s.astype(np.float32).tobytes() for _, s in got], pa.binary())], ["doc_id", "key", "y", "m", "s"]
            )

    rows = common.labelled(docs, labels, "quality", common.bucket_of(F.col("doc_id"), 5) == 0, most)
    got = common.one_each(rows.mapInArrow(common.tidied(run), "doc_id long, key long, y int, m binary, s binary"), ["y", "m", "s"])
    y = np.array(got["y"].to_pylist(), float)
    if not len(y) or y.min() == y.max():
        width = 1 + 4 * OWN
        rate = (y.sum() + 1) / (len(y) + 2)
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "trans": np.zeros((2, 2)), "a": 0.1, "c": float(np.log(rate / (1 - rate)))}
    return fit([np.frombuffer(m, np.float32).reshape(-1, OWN).astype(float) for m in got["m"].to_pylist()], [np.frombuffer(s, np.float32).astype(float) for s in got["s"].to_pylist()], y)


def score(docs: DataFrame, model: dict, column: str = "__quality") -> DataFrame:
    """``docs`` with one more column (__quality, if not another name is given): 0 to 1.  All other columns stay; a text without words counts as one empty line."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for i in range(0, len(series), 500):
                got = [measures(t or "") for t in series.iloc[i : i + 500]]
                share = good_share([m for m, _ in got], [s for _, s in got], model)
                z = np.log((share + 0.01) / (1.01 - share))
                out.append(1 / (1 + np.exp(-(model["a"] * z + model["c"]))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(column, F.pandas_udf(scored, "double")(F.col("text").cast("string")))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores every whole text; see ``train`` and ``score``.

    A row with a null doc_id is scored and is not held out; repeated rows get equal scores; no rows give none.
    """
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = score(common.texts(docs), model)
    held = F.coalesce(common.bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= 0.3).cast("int").alias("predicted"))
