"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents, as TF-IDF vectors over the telling terms of the benchmark (those of few of its items), are sketched by a
distributed randomised SVD.  One pass counts the terms and sums T'(T G) over tasks, for the passages' term counts T and a random G; with D,
the inverse frequencies, D T'(T G) is A'A of the TF-IDF matrix A = T D applied to D^-1 G.  The items join the passages with a weight.
From this a Nystrom step on the driver gives the singular vectors.  Windows of each document, about as long as an item, and the items
meet in the latent space; windows of high cosine to an item are candidates, and nothing else is.  A candidate counts if the longest common
subsequence of its words and the item's covers nearly all of the item, or if it covers most of it (so that changed or inserted
words do not hide it) and the item's rarest terms, which carry its answer, occur there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

#: Words from one window to the next; a window is one to MOST_STRIDES of them; passages for the statistics stand side by side.
STRIDE, MOST_STRIDES, PASSAGE = 12, 4, 36
RANK, OVER = 128, 16
#: A term is telling if at most this share of the items has it (or two do), or if its item has fewer than LEAST_TERMS others.
TELLING, LEAST_TERMS = 0.05, 4
#: All items together weigh so many times what the passages do.
ITEM_WEIGHT = 64.0
#: Least cosine of a window, in units of what the item's own text has in the latent space.
COSINE = 0.45
#: Share of an item that settles the matter, and share that needs ANSWER of its ANSWER_TERMS rarest terms too.
SETTLED, COVERED, ANSWER, ANSWER_TERMS = 0.8, 0.7, 0.4, 5
#: Items of one pass over the documents, in bytes of their texts; more items take more passes.
BLOCK_BYTES = 4 << 20
#: Products of terms and items that are held at once as a table.
TABLE = 1 << 24
_EDGES = b".,!?;:\"'()[]{}"


def terms(text: str) -> list[bytes]:
    """Words at ASCII white space, without case (A-Z) and without marks at their ends; words of marks only stay out."""
    return [w for x in common.words_of(text) if (w := x.strip(_EDGES))]


class Terms:
    """Numbers of terms, by their hashes."""

    def __init__(self, vocabulary: list[bytes]):
        h = common.word_hashes(b"\n".join(vocabulary))[0]  # terms hold no white space
        self.order = np.argsort(h).astype(np.int32)
        self.hashes = h[self.order]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the terms' numbers in order; -1 for terms that are not in the vocabulary."""
        found = common.hashed_words([common.lowered(t) for t in texts], _EDGES)
        if not found:
            return []
        h = np.concatenate(found)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = np.where(self.hashes[at] == h, self.order[at], np.int32(-1))
        return np.split(known, np.cumsum([len(x) for x in found[:-1]]))


def masks_of(pattern: list[int]) -> dict[int, int]:
    """By item, the bits of its places in the pattern."""
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def lcs(pattern: list[int], text: list[int], masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of the pattern."""
    masks = masks_of(pattern) if masks is None else masks
    full = (1 << len(pattern)) - 1
    v = full
    for x in text:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def statistics(docs: DataFrame, vocabulary: list[bytes], telling: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages with each term and, last, all passages; T'(T G); G) over all passages of all documents, for the telling terms."""
    number = np.where(telling, np.cumsum(telling) - 1, -1)
    width, k = int(telling.sum()), columns
    g = np.random.default_rng(5).standard_normal((width, k)).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, np.append(number, -1), g))  # of a block of items

    def each(passage, term, total, product, g):
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        y = np.add.reduceat(g[term], starts, axis=0)
        nth = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        order = np.argsort(term.astype(np.uint16) if width < 2**16 else term, kind="stable")
        t, p = term[order], nth[order]
        edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        new = np.concatenate([[True], p[1:] != p[:-1]])
        new[edges] = True
        total[t[edges]] += np.add.reduceat(new.astype(np.float32), edges)
        product[t[edges]] += np.add.reduceat(y[p], edges, axis=0)

    def run(batches):
        import pyarrow as pa

        vocabulary, number, g = held.value
        known, total = Terms(vocabulary), np.zeros(width + 1 + width * k, np.float32)
        product = total[width + 1 :].reshape(width, k)
        passages, found, size, before = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 60):
                for t in known.numbers(batch.slice(at, 60).column(0).to_pylist()):
                    t = number[t]
                    hit = np.flatnonzero(t >= 0)
                    passages.append(hit // PASSAGE + before)
                    found.append(t[hit])
                    before += len(t) // PASSAGE + 1
                    size += len(hit)
                if size > 20_000:
                    each(np.concatenate(passages), np.concatenate(found), total, product, g)
                    total[width] += before
                    passages, found, size, before = [], [], 0, 0
        if size:
            each(np.concatenate(passages), np.concatenate(found), total, product, g)
        total[width] += before
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["table"])

    got = common.tree_sum(common.texts(docs).select("text").mapInArrow(common.tidied(run), "table binary"), "<f4", width + 1 + width * k)
    return got[: width + 1].astype(float), got[width + 1 :].reshape(width, k).astype(float), g.astype(float)


def latent_basis(product: np.ndarray, g: np.ndarray, idf: np.ndarray, energy: float, items: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix of all passages and the items, by a Nystrom step.

    The items come as entries (row in ``items``, column in ``places``, value); ``energy`` is the passages' sum of squares.
    """
    weight = ITEM_WEIGHT * max(energy, 1.0) / max(1e-12, float((values**2).sum()))
    test = g / idf[:, None]
    rows = int(items.max()) + 1 if len(items) else 0
    own = np.zeros((rows, test.shape[1]))
    np.add.at(own, items, values[:, None] * test[places])
    y = product * idf[:, None]
    np.add.at(y, places, weight * values[:, None] * own[items])
    y += 1e-8 * max(1e-12, np.linalg.norm(y) / np.linalg.norm(test)) * test
    core = test.T @ y
    found, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = found > 1e-9 * max(found.max(), 1e-12)
    u, _, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(found[keep])), full_matrices=False)
    return u[:, :RANK]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered): documents that hold a benchmark item, with the share of its words found in order.

    Whole texts are searched.  Items without words and empty or null texts match nothing; rows that repeat match
    alike (a row each); a null doc_id or item_id is carried as it is; items with the same text all match.  An empty table on either side gives no rows.
    Items are taken in blocks of bounded size, each block in one more pass over the documents.
    """
    spark = docs.sparkSession
    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = held.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    out = spark.createDataFrame([], "doc_id long, item_id long, covered double")
    for block in range(n):
        part = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).toArrow()
        out = out.union(_block_matches(docs, list(zip(part["item_id"].to_pylist(), part["text"].to_pylist()))))
    return out


def _block_matches(docs: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
    spark = docs.sparkSession
    words = [(i, terms(t)) for i, t in items]
    words = [(i, w) for i, w in words if w]
    if not words:
        return spark.createDataFrame([], "doc_id long, item_id long, covered double")
    vocabulary = sorted({x for _, ws in words for x in ws})
    place = {w: k for k, w in enumerate(vocabulary)}
    numbers = [np.array([place[x] for x in ws]) for _, ws in words]
    distinct = [np.unique(x) for x in numbers]
    spread = np.bincount(np.concatenate(distinct), minlength=len(vocabulary))
    telling = spread <= max(2, TELLING * len(words))
    for u in distinct:
        if telling[u].sum() < LEAST_TERMS:
            telling[u[np.argsort(spread[u], kind="stable")[:LEAST_TERMS]]] = True
    width = int(telling.sum())
    counts, product, g = statistics(docs, vocabulary, telling, min(RANK + OVER, width))
    idf = np.log((counts[width] + 2) / (counts[:width] + 1)) + 1e-3
    whole = np.zeros(len(vocabulary) + 1)  # the last stands for all other terms
    whole[:-1][telling] = idf
    number = np.cumsum(telling) - 1
    row = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    term = np.concatenate(numbers)
    row, term = row[telling[term]], number[term[telling[term]]]
    cells, times = np.unique(row * width + term, return_counts=True)
    row, term = cells // width, cells % width
    values = times * idf[term]
    basis = latent_basis(product, g, idf, float((counts[:width] * idf**2).sum()), row, term, values)
    latent = np.zeros((len(numbers), basis.shape[1]))
    np.add.at(latent, row, values[:, None] * basis[term])
    norm = np.sqrt(np.bincount(row, weights=values**2, minlength=len(numbers)))
    # a window's product with a column, over its norm, is at least 1 if its cosine to the item suffices
    latent *= (norm / (COSINE * np.maximum((latent**2).sum(1), 1e-6 * norm**2)))[:, None]
    strides = np.clip(np.round(np.array([len(x) for x in numbers]) / STRIDE), 1, MOST_STRIDES).astype(int)
    order = np.argsort(strides, kind="stable")
    latent, strides = latent[order].astype(np.float32), strides[order]
    numbers, ids = [numbers[i].tolist() for i in order], [words[i][0] for i in order]
    rare = np.append(np.where(telling, whole[:-1], -1.0), -2.0)
    answers = [set(sorted(set(x), key=lambda k: (-rare[k], k))[:ANSWER_TERMS]) for x in numbers]
    number = np.append(np.where(telling, number, -1), -1)
    projected = (basis * idf[:, None]).astype(np.float32)
    at_once = len(projected) * len(latent) <= TABLE
    held = spark.sparkContext.broadcast((vocabulary, number, projected @ latent.T if at_once else projected, latent, (idf**2).astype(np.float32), numbers, answers, strides, ids))  # of a block of items

    def run(batches):
        import pyarrow as pa

        vocabulary, number, table, latent, squares, numbers, answers, strides, ids = held.value
        known, masks = Terms(vocabulary), [masks_of(x) for x in numbers]
        parts = [(b, np.flatnonzero(strides == b)) for b in range(1, MOST_STRIDES + 1) if (strides == b).any()]

        def candidates(t):
            """(item, first word of a window, its words) of high cosine."""
            told = number[t]
            hit = np.flatnonzero(told >= 0)
            if not len(hit):
                return
            told, nth = told[hit], hit // STRIDE
            first = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]]))
            n = -(-len(t) // STRIDE)
            sums, norms = np.zeros((n, table.shape[1]), np.float32), np.zeros(n, np.float32)
            sums[nth[first]], norms[nth[first]] = np.add.reduceat(table[told], first, axis=0), np.add.reduceat(squares[told], first)
            over = lambda x, b: sum(x[i : i + max(1, len(x) - b + 1)] for i in range(min(b, len(x))))  # noqa: E731  sums of b neighbours
            for b, own in parts:
                norm = np.sqrt(over(norms, b))
                norm[norm == 0] = np.inf
                for i in range(0, len(own), 1024):
                    some = own[i : i + 1024]
                    # the items stand in order of their strides
                    found = over(sums[:, some[0] : some[-1] + 1], b) if at_once else over(sums, b) @ latent[some].T
                    for j, k in zip(*(x.tolist() for x in np.nonzero(found >= norm[:, None]))):
                        yield int(some[k]), j * STRIDE, b * STRIDE

        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 60):
                part = batch.slice(start, 60)
                for doc_id, t in zip(part.column(0).to_pylist(), known.numbers(part.column(1).to_pylist())):
                    best: dict[int, float] = {}
                    for item, first, size in candidates(t) if len(t) else ():
                        x = numbers[item]
                        m = len(x)
                        span = t[max(0, first - m) : first + size + m].tolist()
                        share = lcs(x, span, masks[item]) / m
                        if share >= SETTLED or share >= COVERED and len(answers[item].intersection(span)) >= ANSWER * len(answers[item]):
                            best[item] = max(share, best.get(item, 0.0))
                    out += [(doc_id, ids[item], share) for item, share in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["doc_id", "item_id", "covered"])

    return common.texts(docs).mapInArrow(common.tidied(run), "doc_id long, item_id long, covered double")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contaminated documents: doc_id, item_id and the covered share.  Nulls, empty texts, repeated rows and empty tables as in ``matches``."""
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))
