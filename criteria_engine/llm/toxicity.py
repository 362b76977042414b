"""Toxicity: a convolutional text classifier, trained in numpy by many tasks.

A word is the sum of hashed embeddings of itself, its beginnings and its end. Filters of
several widths slide over the words of the whole text; each filter's largest value in
the text goes to a logistic layer. The model learns from all labelled rows that are not
held out, each with its whole text: a fifth of them (by a hash of the id) sets a threshold
for each language, the others train. In a round every task passes once over its part of
them, from the same weights, and the weights it moved are averaged, block by block of the
embedding table. Language, source and id are never inputs of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import codes, held_out, release, slices, words
from criteria_engine.operators.bloom import likely_in

# Rows that one task learns from in a round, and words that it mixes at once.
TASK_ROWS = 8000
MIXED_WORDS = 1 << 20
# Text whose words a worker looks up at once; with the filters' values they take up to eighty times as much.
TEXT_BYTES = 1 << 20
ROWS, WIDTH, FILTERS, WIDTHS = 1 << 18, 12, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 3, 32, 0.08
# Few rows are seen more often, until so many steps are made.
STEPS = 500
# Rows of the embedding table whose weights are averaged together.
BLOCK = 1 << 10
# Parts of a unit of log-odds in which scores are counted for a threshold.
CELLS = 64
THRESHOLD = 0.3
# A language has a threshold of its own if so many rows of each label can set it.
LEAST_ROWS = 10
EDGES = ".,;:!?\"'()[]{}<>|*_-…«»“”‘’¡¿"
PAD = max(WIDTHS) - 1
SCORES = "doc_id long, held_out boolean, score double, lang string"


def features(vocabulary: pa.Array) -> np.ndarray:
    """Rows of the embedding table for each word: whole, first 4, first 6, last 5 letters."""
    plain = pc.utf8_trim(pc.utf8_lower(vocabulary), characters=EDGES)
    parts = [
        plain,
        pc.utf8_slice_codeunits(plain, 0, 4),
        pc.utf8_slice_codeunits(plain, 0, 6),
        pc.utf8_reverse(pc.utf8_slice_codeunits(pc.utf8_reverse(plain), 0, 5)),
    ]
    out = np.empty((len(vocabulary), len(parts)), np.int32)
    for k, part in enumerate(parts):
        hashed = pd.util.hash_array(part.to_numpy(zero_copy_only=False), hash_key=f"{k}" * 16)
        out[:, k] = hashed % ROWS
    return out


def _laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, and of each text's start, if PAD empty words follow each text."""
    room = np.maximum(lengths, 1) + PAD
    starts = np.cumsum(room) - room
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(lengths.sum()) + shift, starts


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray
    thresholds: dict

    def pooled(self, vectors: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text; order: the words as rows of vectors."""
        place, starts = _laid_out(lengths)
        size = int((np.maximum(lengths, 1) + PAD).sum())
        at = np.full(size + PAD, len(vectors), np.int64)
        at[place] = order
        found = []
        for w, filters, bias in zip(WIDTHS, self.filters, self.bias):
            total = None
            for j in range(w):
                # each distinct word meets each row of the filter once
                met = np.vstack([vectors @ filters[j], np.zeros((1, filters.shape[2]), vectors.dtype)])
                part = met[at[j : size + j]]
                total = part if total is None else np.add(total, part, out=total)
            total[_gaps(starts, lengths, size)] = -np.inf
            found.append(np.maximum.reduceat(total, starts) + bias)
        return np.maximum(np.hstack(found), 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        flat, offsets = words(texts)
        vectors = self.table[features(flat.dictionary)].sum(1)
        pooled = self.pooled(vectors, codes(flat), np.diff(offsets))
        return 1 / (1 + np.exp(-np.clip((pooled @ self.out + self.shift).astype(np.float64), -500, 500)))


def _gaps(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    gap = np.ones(size, bool)
    first = np.maximum(lengths, 1)
    gap[np.arange(first.sum()) + np.repeat(starts - (np.cumsum(first) - first), first)] = False
    return gap


def new_model(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Model(
        (rng.normal(0, 0.05, (ROWS, WIDTH))).astype(np.float32),
        [draw(w, WIDTH, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(FILTERS * len(WIDTHS)),
        np.zeros(1, np.float32),
        {},
    )


def _dense(model: Model) -> dict:
    """All weights but the embeddings, by name; the arrays are the model's own."""
    each = {(k, j): f[j] for k, f in enumerate(model.filters) for j in range(len(f))}
    return {"out": model.out, "shift": model.shift, **each, **{("bias", k): b for k, b in enumerate(model.bias)}}


def new_squares(model: Model) -> dict:
    """What Adagrad keeps for each weight."""
    return {name: np.full_like(w, 1e-3) for name, w in {**_dense(model), "table": model.table}.items()}


def train(model: Model, squares: dict, texts: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One pass in place; texts: per text, rows of `features` of its words. Adagrad on the logistic loss.

    Returns the embeddings it moved.
    """
    touched = [np.empty(0, np.int64)]

    def step(name, weights, gradient, at=...):
        squares[name][at] += gradient**2
        weights[at] -= RATE * gradient / np.sqrt(squares[name][at])

    for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
        lengths = np.array([len(texts[i]) for i in batch])
        place, starts = _laid_out(lengths)
        size = int((np.maximum(lengths, 1) + PAD).sum())
        rows = np.concatenate([texts[i] for i in batch])
        x = np.zeros((size + PAD, WIDTH), np.float32)
        x[place] = model.table[rows].sum(1)
        gap, pooled, at = _gaps(starts, lengths, size), [], []
        for w, filters, bias in zip(WIDTHS, model.filters, model.bias):
            y = sum(x[j : size + j] @ filters[j] for j in range(w))
            y[gap] = -np.inf
            best = np.array([s + y[s : s + max(n, 1)].argmax(0) for s, n in zip(starts, lengths)])
            at.append(best)
            pooled.append(np.take_along_axis(y, best, 0) + bias)
        raw = np.hstack(pooled)
        hidden = np.maximum(raw, 0)
        score = 1 / (1 + np.exp(-(hidden @ model.out + model.shift)))
        wrong = ((score - toxic[batch]) / len(batch)).astype(np.float32)
        back = wrong[:, None] * model.out * (raw > 0)
        step("out", model.out, hidden.T @ wrong)
        step("shift", model.shift, wrong.sum(keepdims=True))
        dx = np.zeros_like(x)
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                place_j = at[k] + j
                np.add.at(dx, place_j, g[..., None] * model.filters[k][j].T)
                step((k, j), model.filters[k][j], np.einsum("bf,bfd->df", g, x[place_j]))
            step(("bias", k), model.bias[k], g.sum(0))
        of_word = dx[place]
        moved = np.flatnonzero(np.abs(of_word).sum(1))
        if len(moved):
            ids, inverse = np.unique(rows[moved], return_inverse=True)
            total = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(total, inverse.reshape(len(moved), -1), of_word[moved][:, None])
            step("table", model.table, total, ids)
            touched.append(ids)
    return np.unique(np.concatenate(touched))


def best_cut(low: np.ndarray, high: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> float:
    """The threshold of highest F1, nearest to THRESHOLD among equals.

    Cells of scores in rising order, each from `low` to `high` with its `rows`, `hits` of them
    toxic; no cell has THRESHOLD inside. Thresholds between any two cells are tried.
    """
    edges = np.concatenate([[0.0], high]), np.concatenate([low, [1.0]])
    apart = edges[0] < edges[1]
    options = np.append((edges[0] + edges[1])[apart] / 2, THRESHOLD)
    above = np.append(np.flatnonzero(apart), np.searchsorted(low, THRESHOLD))
    caught, found = (np.append(np.cumsum(n[::-1])[::-1], 0)[above] for n in (hits, rows))
    f1 = 2 * caught / np.maximum(found + hits.sum(), 1)
    best = np.flatnonzero(f1 == f1.max())
    return float(options[best[np.abs(options[best] - THRESHOLD).argmin()]])


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """`best_cut` of single scores."""
    each, inverse, rows = np.unique(scores, return_inverse=True, return_counts=True)
    return best_cut(each, each, rows, np.bincount(inverse, toxic == 1, len(each)))


def learned_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, toxic, text, lang and `tested` of all rows to learn from; how many parts they have.

    A part has about TASK_ROWS rows. `tested` rows set the thresholds. A repeated id gives one text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    n = known.count()
    parts = max(1, -(-n // TASK_ROWS))
    mixed = F.xxhash64("doc_id")
    # hardly any text without a label moves; the same parts in the same order, whatever shuffled them
    near = likely_in(rows, known, "doc_id", n).join(known.hint("merge"), "doc_id")
    found = near.repartition(parts, "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text"), F.min("lang").alias("lang")
    )
    return found.withColumn("tested", F.pmod(mixed, F.lit(5)) == 0).sortWithinPartitions(mixed, "doc_id"), parts


def _mixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts as rows of `features`, MIXED_WORDS words at a time, and their labels."""
    texts, toxic, held = [], [], 0
    for batch in slices(batches, "text", TEXT_BYTES):
        flat, offsets = words(batch.column("text"))
        rows = features(flat.dictionary)[codes(flat)]
        for i, label in enumerate(batch.column("toxic").to_pylist()):
            texts.append(rows[offsets[i] : offsets[i + 1]])
            toxic.append(label)
            held += len(texts[-1])
            if held >= MIXED_WORDS:
                yield texts, np.array(toxic, np.float32)
                texts, toxic, held = [], [], 0
    if texts:
        yield texts, np.array(toxic, np.float32)


def _round(rows: DataFrame, model: Model, squares: dict, seed: int, passes: int) -> None:
    """Every task passes over its part from the same weights; each weight becomes the mean of those who moved it."""
    shared = rows.sparkSession.sparkContext.broadcast((model, squares))  # a fixed size, about 25 MB

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        model, squares = deepcopy(shared.value)
        rng, touched = np.random.default_rng([seed, task]), None
        for texts, toxic in _mixes(batches):
            for _ in range(passes):
                ids = train(model, squares, texts, toxic, rng)
                touched = ids if touched is None else np.union1d(touched, ids)
        if touched is None:
            return
        own = _dense(model)
        dense = np.concatenate([a.ravel() for a in (*own.values(), *(squares[n] for n in own))])
        out = [(-1, b"", dense.tobytes())]
        for block in np.unique(touched // BLOCK):
            ids = touched[touched // BLOCK == block]
            moved = np.hstack([model.table[ids], squares["table"][ids]])
            out.append((int(block), ids.astype(np.int64).tobytes(), moved.tobytes()))
        block, ids, moved = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array([task] * len(out), pa.int32()), pa.array(ids, pa.binary()), pa.array(moved, pa.binary())],
            ["block", "task", "ids", "moved"],
        )

    def mean(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("task")
        moved = [np.frombuffer(m, np.float32) for m in found["moved"]]
        if found["block"].iloc[0] < 0:
            ids, total = b"", np.mean(moved, 0, np.float64)
        else:
            at = np.concatenate([np.frombuffer(i, np.int64) for i in found["ids"]])
            each, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
            total = np.zeros((len(each), 2 * WIDTH))
            np.add.at(total, inverse, np.concatenate(moved).reshape(-1, 2 * WIDTH))
            ids, total = each.tobytes(), total / n[:, None]
        return pd.DataFrame({"block": found["block"].iloc[:1], "ids": [ids], "moved": [total.astype(np.float32).tobytes()]})

    parts = rows.where("not tested").select("toxic", "text").mapInArrow(learn, "block int, task int, ids binary, moved binary")
    means = parts.groupBy("block").applyInPandas(mean, "block int, ids binary, moved binary").collect()  # one model
    shared.unpersist()
    for r in means:
        moved = np.frombuffer(r["moved"], np.float32)
        if r["block"] >= 0:
            ids, moved = np.frombuffer(r["ids"], np.int64), moved.reshape(-1, 2 * WIDTH)
            model.table[ids], squares["table"][ids] = moved[:, :WIDTH], moved[:, WIDTH:]
            continue
        own = _dense(model)
        arrays = [*own.values(), *(squares[n] for n in own)]
        for array, part in zip(arrays, np.split(moved, np.cumsum([a.size for a in arrays])[:-1])):
            array[...] = part.reshape(array.shape)


def _cells(rows: DataFrame, model: Model) -> DataFrame:
    """Per language with enough rows, its `threshold`; every row of `rows` is counted.

    Scores are counted in cells of 1/CELLS of log-odds, cut at THRESHOLD: a language has a bounded number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            found = pa.array(shared.value.scores(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), found], ["lang", "toxic", "score"])

    def cut(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("low")
        best = best_cut(*(cells[c].to_numpy() for c in ("low", "high", "rows", "hits")))
        return pd.DataFrame({"lang": cells["lang"].iloc[:1], "threshold": [best]})

    scored = rows.where("coalesce(lang, '') != ''").select("lang", "toxic", "text").mapInArrow(
        add_scores, "lang string, toxic int, score double"
    )
    odds = F.log(F.col("score") / (1 - F.col("score")))
    # the odds of 0 and 1 are null or endless, so each end is one cell
    cell = F.when(F.col("score") <= 1e-12, -(1 << 20)).when(F.col("score") >= 1 - 1e-12, 1 << 20)
    cells = scored.groupBy("lang", cell.otherwise(F.floor(odds * CELLS)).alias("cell"), (F.col("score") >= THRESHOLD).alias("over")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("rows"), F.sum("toxic").alias("hits")
    )
    enough = cells.groupBy("lang").agg(F.sum("hits").alias("of_1"), F.sum(F.col("rows") - F.col("hits")).alias("of_0"))
    enough = enough.where(F.least("of_0", "of_1") >= LEAST_ROWS).select("lang")
    return cells.join(enough, "lang", "left_semi").groupBy("lang").applyInPandas(cut, "lang string, threshold double")


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """A model; without rows of both labels, one that scores every text the same."""
    (rows, parts), model = learned_rows(docs, labels), new_model(seed)
    rows.persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {(r["toxic"], r["tested"]): r["count"] for r in rows.groupBy("toxic", "tested").count().collect()}
        toxic = [sum(n for (label, _), n in sizes.items() if label == t) for t in (0, 1)]
        if not all(toxic):
            model.out[:] = 0
            model.shift[:] = -3.0 if not toxic[1] else 3.0
            return model
        squares = new_squares(model)
        of_task = sum(n for (_, tested), n in sizes.items() if not tested) / parts
        passes = max(1, int(np.ceil(STEPS * BATCH / (EPOCHS * max(1, of_task)))))
        for turn in range(EPOCHS):
            _round(rows, model, squares, seed + turn, passes)
            release(docs.sparkSession)  # what the round shuffled
        model.thresholds = {r["lang"]: r["threshold"] for r in _cells(rows.where("tested"), model).collect()}
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3), threshold, rejected.

    `rejected` compares the score with the threshold of the row's language (0.3 where it
    has none or is null). Null and empty texts are scored as texts without words. Repeated
    rows are each scored; other columns are dropped unless named in `keep`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, about 13 MB
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[4:])

    def add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            found = pa.array(shared.value.scores(batch.column("text")))
            columns = [batch.column("doc_id"), batch.column("held_out"), found, batch.column("lang")]
            rest = batch.schema.names[4:]
            columns += [batch.column("text"), *(batch.column(c) for c in rest)] if keep else []
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "held_out", "score", "lang", *(["text", *rest] if keep else [])]
            )

    scored = rows.mapInArrow(add_scores, SCORES + (", text string" + kept if keep else ""))
    own = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair]) if model.thresholds else None
    limit = F.coalesce(own[F.col("lang")], F.lit(THRESHOLD)) if own is not None else F.lit(THRESHOLD)
    return scored.withColumns(
        {
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
            "threshold": limit,
            "rejected": F.col("score") >= limit,
        }
    )
