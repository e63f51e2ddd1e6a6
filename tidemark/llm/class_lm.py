"""Language-model scoring with Brown class bigrams (operator 10).

Every word of the training documents is counted.  Core words, of at least
1 / CORE_SHARE of all training tokens, are put into classes by the exchange
algorithm: each word in turn moves to the class that raises the class-bigram
likelihood most, on their table of neighbour counts.  Known words, of at least
1 / KNOWN_SHARE of all tokens, then make one exchange step each, in parallel,
against the core's classes, from the classes of their own neighbours.  (Shares
bound the numbers of both: at most CORE_SHARE and KNOWN_SHARE words.)  All
other words form the class "rest", and the end of a text is a class of its own.
A token's probability is that of its class after the class before it, times
that of the word in its class; transitions are smoothed with the class
frequencies, words of the rest by adding one.

Classes and counts of known words travel to the scoring tasks; the other words
of a text meet their counts in a join, so no task needs the whole vocabulary
and no word in that join is common.

Defined cases: a null text is an empty one and has the end token only; without
training documents every count is zero; a null id belongs to the training
fold; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, text_of, whole_texts
from tidemark.llm.words import slices, words_of
from tidemark.session import materialise

HELD_OUT = 2
CORE_SHARE = 3_000
KNOWN_SHARE = 1_000_000
CLASSES = 48
SWEEPS = 8
#: Word counts that a task gathers before it folds them.
GATHERED = 1_000_000
END = ""  # words are never empty


def _fold_counts(tables: list[pa.Table]) -> pa.Table:
    folded = pa.concat_tables(tables).group_by("word").aggregate([("n_train", "sum"), ("n_all", "sum")])
    return folded.rename_columns({"n_train_sum": "n_train", "n_all_sum": "n_all"})


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, folded as they come."""
    tables: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"))
            trained = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            size = len(words.dictionary)
            found = {
                "word": pa.concat_arrays([words.dictionary, pa.array([END], pa.string())]),
                "n_train": np.append(np.bincount(words.codes[trained[words.owners]], minlength=size), trained.sum()),
                "n_all": np.append(np.bincount(words.codes, minlength=size), len(trained)),
            }
            tables.append(pa.table(found))
            if sum(t.num_rows for t in tables) > GATHERED:
                tables = [_fold_counts(tables)]
                if tables[0].num_rows > GATHERED // 2:
                    yield from tables.pop().to_batches()
    if tables:
        yield from _fold_counts(tables).to_batches()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n_train, n_all) of all rows (text, held_out); the end of a text is the empty word."""
    counted = rows.select("text", "held_out").mapInArrow(_count_batches, "word string, n_train bigint, n_all bigint")
    return counted.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _places(dictionary: pa.Array, listed: pa.Array) -> np.ndarray:
    """Place of each word in ``listed``, or its length."""
    return pc.fill_null(pc.index_in(dictionary, value_set=listed), len(listed)).to_numpy(zero_copy_only=False)


def _sequence(places: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Tokens of all texts in a row, an end before the first and after each."""
    out = np.full(len(places) + len(counts) + 1, end, np.int64)
    out[1 + np.arange(len(places)) + np.repeat(np.arange(len(counts)), counts)] = places
    return out


def _pair_batches(batches: Iterator[pa.RecordBatch], core) -> Iterator[pa.RecordBatch]:
    """Neighbour counts of core words, rest and end within a task."""
    listed = core.value
    size = len(listed) + 2
    seen: list[tuple[np.ndarray, np.ndarray]] = []

    def folded() -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate([p for p, _ in seen]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([n for _, n in seen])).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"))
            row = _sequence(_places(words.dictionary, listed)[words.codes], words.counts, size - 1)
            seen.append(np.unique(row[:-1] * size + row[1:], return_counts=True))
            if sum(len(p) for p, _ in seen) > GATHERED:
                seen = [folded()]
    if seen:
        pairs, counts = folded()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])


def neighbour_counts(rows: DataFrame, core: pa.Array) -> np.ndarray:
    """Square table of how often one core word (or rest, or end) follows another in the training rows."""
    shared = rows.sparkSession.sparkContext.broadcast(core)
    trained = rows.where(~F.col("held_out")).select("text")
    pairs = trained.mapInArrow(lambda batches: _pair_batches(batches, shared), "pair bigint, n bigint")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    size = len(core) + 2
    table = np.zeros(size * size)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(table: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each row of ``table``; the last two rows, rest and end, keep classes of their own.

    Rows come in falling frequency and start dealt round.  A move of word w
    from class a changes only the rows and columns of a and of the new class
    in the class table, so its gain is a few vector sums.
    """
    words = len(table) - 2
    groups = min(classes, max(words, 1))
    total = groups + 2
    member = np.append(np.arange(words) % groups, [groups, groups + 1])
    chosen = np.eye(total)[member]
    after, before = table @ chosen, table.T @ chosen  # word followed by class, word preceded by class
    grid = chosen.T @ after
    size = table.sum(axis=1)
    held = np.bincount(member, size, minlength=total)
    for _ in range(sweeps):
        moves = 0
        for w in range(words):
            a, own = member[w], table[w, w]
            # The class table without w.  Its pair with itself is counted in both of its vectors.
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            held[a] -= size[w]
            rows, columns = grid[:groups], grid[:, :groups].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
            inner, at = grid.diagonal()[:groups], np.arange(groups)
            gain -= _xlogx(inner + right[at]) + _xlogx(inner + left[at]) - 2 * _xlogx(inner)
            gain += _xlogx(inner + right[at] + left[at] + own) - _xlogx(inner)
            gain -= 2 * (_xlogx(held[:groups] + size[w]) - _xlogx(held[:groups]))
            g = int(np.argmax(gain + 1e-9 * (at == a) * max(abs(gain[a]), 1.0)))
            grid[g] += right
            grid[:, g] += left
            grid[g, g] += own
            held[g] += size[w]
            if g != a:
                moves += 1
                member[w] = g
                after[:, a] -= table[:, w]
                after[:, g] += table[:, w]
                before[:, a] -= table[w]
                before[:, g] += table[w]
        if moves * 100 <= words:
            break
    return member


def _class_pairs(words, known: pa.Array, classes: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among the known words, and classes, of all tokens in a row, an end before the first and after each text."""
    places = _places(words.dictionary, known)[words.codes]
    row = _sequence(places, words.counts, len(known) + 1)
    return row, np.append(classes, [total - 2, total - 1])[row]


def _context_batches(batches: Iterator[pa.RecordBatch], shared, total: int) -> Iterator[pa.RecordBatch]:
    """(word, context, n) of known words without a class: classes of what follows, then of what goes before."""
    known, classes = shared.value
    seen: list[tuple[np.ndarray, np.ndarray]] = []

    def folded() -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([p for p, _ in seen]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in seen])).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            row, kind = _class_pairs(words_of(part.column("text")), known, classes, total)
            open_word = np.append(classes == total - 2, [False, False])[row]
            after, before = open_word[:-1], open_word[1:]
            codes = [row[:-1][after] * 2 * total + kind[1:][after], (row[1:][before] * 2 + 1) * total + kind[:-1][before]]
            seen.append(np.unique(np.concatenate(codes), return_counts=True))
            if sum(len(p) for p, _ in seen) > GATHERED:
                seen = [folded()]
                if len(seen[0][0]) > GATHERED // 2:
                    yield _contexts(*seen.pop(), total)
    if seen:
        yield _contexts(*folded(), total)


def _contexts(codes: np.ndarray, counts: np.ndarray, total: int) -> pa.RecordBatch:
    word, context = np.divmod(codes, 2 * total)
    columns = [pa.array(word), pa.array(context.astype(np.int32)), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, ["word", "context", "n"])


def _assign_batches(batches: Iterator[pa.RecordBatch], gains) -> Iterator[pa.RecordBatch]:
    """Best class of each word from all its contexts, which lie together and in order."""
    rest: pa.Table | None = None

    def best(table: pa.Table) -> pa.RecordBatch:
        words, place = np.unique(table.column("word").to_numpy(), return_inverse=True)
        vectors = np.zeros((len(words), gains.value.shape[0]))
        np.add.at(vectors, (place, table.column("context").to_numpy()), table.column("n").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array((vectors @ gains.value).argmax(1))], ["word", "class"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        words = rest.column("word").to_numpy()
        cut = int(np.searchsorted(words, words[-1])) if len(words) else 0  # the last word may go on
        if cut:
            yield best(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield best(rest)


def exchange_step(rows: DataFrame, known: pa.Array, classes: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Classes of the known words, those still in the rest moved to the core class that their neighbours favour most.

    Putting a word into a class adds, for each neighbour, the logarithm of how
    much more often the class meets the neighbour's class than by chance.
    """
    total = len(grid)
    size = grid.sum(axis=0) + 1.0
    chance = np.outer(size, size) / size.sum()
    ratio = np.log((grid + 1.0 / total) / chance)[: total - 2]  # class by what follows
    back = np.log((grid.T + 1.0 / total) / chance)[: total - 2]  # class by what goes before
    context = rows.sparkSession.sparkContext
    shared, gains = context.broadcast((known, classes)), context.broadcast(np.concatenate([ratio.T, back.T]))
    seen = rows.where(~F.col("held_out")).select("text")
    counted = seen.mapInArrow(lambda b: _context_batches(b, shared, total), "word bigint, context int, n bigint")
    folded = counted.groupBy("word", "context").agg(F.sum("n").alias("n"))
    together = folded.repartition("word").sortWithinPartitions("word")
    found = together.mapInArrow(lambda b: _assign_batches(b, gains), "word bigint, class bigint").toArrow()
    out = classes.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


def _grid_batches(batches: Iterator[pa.RecordBatch], shared, total: int) -> Iterator[pa.RecordBatch]:
    known, classes = shared.value
    grid = np.zeros(total * total, np.int64)
    for batch in batches:
        for part in slices(batch):
            _, kind = _class_pairs(words_of(part.column("text")), known, classes, total)
            grid += np.bincount(kind[:-1] * total + kind[1:], minlength=total * total)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(grid)], ["pair", "n"])


def class_grid(rows: DataFrame, known: pa.Array, classes: np.ndarray, total: int) -> np.ndarray:
    """How often each class follows each other one in the training rows."""
    shared = rows.sparkSession.sparkContext.broadcast((known, classes))
    seen = rows.where(~F.col("held_out")).select("text")
    pairs = seen.mapInArrow(lambda b: _grid_batches(b, shared, total), "pair bigint, n bigint")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(total * total)
    grid[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return grid.reshape(total, total)


@dataclass
class ClassModel:
    """What a scoring task needs: bounded tables and a few totals."""

    known: pa.Array
    counts: np.ndarray  # training counts of the known words
    classes: np.ndarray  # of the known words
    emission: np.ndarray  # log10 probability of a known word in its class, 0 in the rest
    steps: np.ndarray  # log10 probability of a class (column) after a class (row); rest and end come last
    tokens: int
    kinds: int
    rest_size: float  # of the rest: tokens + kinds + 1
    end_count: int


def fit(rows: DataFrame) -> tuple[ClassModel, DataFrame]:
    """Model of the training rows, and the stored word counts."""
    counts = materialise(word_counts(rows))
    n_train, is_end = F.col("n_train"), F.col("word") == END
    sums = counts.agg(
        F.sum("n_train").alias("tokens"),
        F.count(F.when(n_train > 0, 1)).alias("kinds"),
        F.sum("n_all").alias("all"),
        F.sum(F.when(is_end, n_train)).alias("ends"),
    ).first()
    tokens, everything, ends = sums["tokens"] or 0, sums["all"] or 0, sums["ends"] or 0
    # Each of these words has that share of all tokens, so there are at most KNOWN_SHARE.
    listed = counts.where(~is_end & (F.col("n_all") * KNOWN_SHARE >= everything)).select("word", "n_train").toArrow()
    listed = listed.sort_by([("n_train", "descending"), ("word", "ascending")])
    known = listed.column("word").combine_chunks().cast(pa.string())
    in_training = listed.column("n_train").to_numpy()
    core = int(np.count_nonzero((in_training > 0) & (in_training * CORE_SHARE >= tokens)))  # the first ones
    member = exchange(neighbour_counts(rows, known.slice(0, core)))
    total = int(member.max()) + 1
    classes = np.full(len(known), total - 2, np.int64)
    classes[:core] = member[:core]
    grid = class_grid(rows, known, classes, total)
    if core and (in_training[core:] > 0).any():
        classes = exchange_step(rows, known, classes, grid)
        grid = class_grid(rows, known, classes, total)
    held = grid.sum(axis=0)  # tokens of each class
    share = (held + 1) / (held.sum() + total)
    moves = (grid + total * share) / (grid.sum(axis=1, keepdims=True) + total)
    classed = classes < total - 2
    emission = np.where(classed, np.log10(np.maximum(in_training, 1) / np.maximum(held[classes], 1)), 0.0)
    rest_size = tokens - ends - in_training[classed].sum() + sums["kinds"] - classed.sum() - (ends > 0) + 1
    model = ClassModel(
        known, in_training, classes, emission, np.log10(moves), tokens, sums["kinds"], float(rest_size), ends
    )
    return model, counts


_PARTS = "uid bigint, word string, times bigint, {id}, held_out boolean, n_tokens bigint, n_known bigint, base double, model double"


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the scores of what is known here, and a row for each of its other words."""
    model: ClassModel = shared.value
    total = len(model.steps)
    for batch in batches:
        for part in slices(batch):
            words, texts = words_of(part.column("text")), part.num_rows
            place = _places(words.dictionary, model.known)
            held = np.append(model.counts, 0)[place]  # of each distinct word
            listed = place < len(model.known)
            token_listed = listed[words.codes]
            kind = np.append(model.classes, total - 2)[place][words.codes]
            row = _sequence(kind, words.counts, total - 1)
            ends = words.ends + np.arange(texts)  # places of the ends among the steps
            run = np.append(0.0, np.cumsum(model.steps[row[:-1], row[1:]]))
            steps = run[ends + 1] - run[np.append(0, ends[:-1] + 1)]
            owners, gain = words.owners, np.where(listed, np.log10(held + 1.0), 0.0)[words.codes]
            base = np.bincount(owners, gain, texts) + np.log10(model.end_count + 1.0)
            base -= (words.counts + 1) * np.log10(model.tokens + model.kinds + 1.0)
            in_rest = kind == total - 2
            within = np.where(in_rest, gain - np.log10(model.rest_size), np.append(model.emission, 0.0)[place][words.codes])
            rest = np.bincount(owners, within, texts)
            n_known = np.bincount(owners, token_listed & (held[words.codes] > 0), texts) + (model.end_count > 0)
            uid = part.column("uid").to_numpy()
            whole = {
                "uid": uid,
                # A blank leads no word: these rows meet nothing, each at a place of its own.
                "word": pa.array([f" {u}" for u in uid.tolist()], pa.string()),
                "times": np.zeros(texts, np.int64),
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "n_tokens": words.counts.astype(np.int64) + 1,
                "n_known": n_known.astype(np.int64),
                "base": base,
                "model": steps + rest,
            }
            yield pa.RecordBatch.from_pydict(whole)
            cells = owners[~token_listed] * max(len(words.dictionary), 1) + words.codes[~token_listed]
            cells, times = np.unique(cells, return_counts=True)
            text, code = np.divmod(cells, max(len(words.dictionary), 1))
            blank = {k: pa.nulls(len(cells), whole_type) for k, whole_type in _kinds(whole).items()}
            other = {"uid": uid[text], "word": words.dictionary.take(pa.array(code)), "times": times.astype(np.int64)}
            yield pa.RecordBatch.from_pydict({**blank, **other})


def _kinds(columns: dict) -> dict[str, pa.DataType]:
    return {k: v.type if isinstance(v, pa.Array) else pa.from_numpy_dtype(v.dtype) for k, v in columns.items()}


def score_documents(docs: DataFrame) -> DataFrame:
    """Unigram and class-bigram log10 probabilities of every document."""
    docs = whole_texts(docs)
    rows = docs.select("doc_id", (fold("doc_id", 7) == HELD_OUT).alias("held_out"), text_of().alias("text"))
    model, counts = fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = _PARTS.format(id=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    parts = numbered.mapInArrow(lambda batches: _score_batches(batches, shared), schema)
    trained = counts.where("n_train > 0").select(F.col("word").alias("_word"), "n_train")
    met = parts.join(trained, F.col("word") == F.col("_word"), "left")
    one = lambda name: F.max(name).alias(name)  # noqa: E731  set in one row of each text
    gathered = met.groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n_train", F.lit(0)) + 1.0)).alias("others"),
        F.sum(F.when(F.col("n_train").isNotNull(), F.col("times")).otherwise(0)).alias("others_known"),
        *[one(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base", "model")],
    )
    return gathered.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("others_known")).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("others")).alias("base_score"),
        (F.col("model") + F.col("others")).alias("score"),
    )
