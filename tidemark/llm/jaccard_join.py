"""N-gram Jaccard join by vertical partitioning (operator 11).

Documents are sets of the hashes of their different five-word shingles; two link
if the exact Jaccard similarity of their sets reaches 0.8.  Equal sets are one
node.  All work follows one global order of the n-grams, cut into fragments.

*Candidates.*  In any global order, the first common n-gram of a linked pair lies
within the first ``n - ceil(0.8 n) + 1`` n-grams (the prefix) of both.  The order
puts n-grams that few nodes hold first, so that prefixes hardly meet by chance:

    0  n-grams of the lower part of the hash range, by number of nodes, then hash
    1  those of the upper part, by hash
    2  n-grams that are frequent in a sample of the documents, by hash

Every fragment, a range of hashes, is sent as packed arrays and counted on its
own; only n-grams that two nodes hold come back.  A node whose n-grams of class 0
that it holds alone fill its prefix has no partner.  Classes 1 and 2 are sent
where class 0 is smaller than the prefix.  The sample steers what is counted, not
what is found: any order gives the same links.

*Overlaps.*  A candidate pair meets fragment by fragment; the common n-grams of
each fragment are counted separately and summed for each pair.

*Long lists.*  Of lists of nodes under one n-gram, those whose nodes all stand
together in a longer list are dropped.  A list of more than PAIRED nodes is not
expanded into pairs: each node meets CENTRES drawn ones.  Where nodes of such a
list are then not connected, those outside of its largest group meet all others
in cells of bounded size, and a cell returns one link for each node and group.
So groups of any size are found whole, and no list is emitted as all its pairs.

Hashes have 64 bits: among 10 ** 9 different sets the chance that any two share
a number is 3 in 100.

Defined cases: a null text is an empty one; fewer words than a shingle make one
shingle of them all; a text without words has no shingle and links with nothing;
a group is named by its smallest id (null if no row of it has one); repeated
rows are each reported; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, row_digest, rows_of, text_of, whole_texts
from tidemark.llm.components import components
from tidemark.llm.words import hashes, mixed, slices, words_of
from tidemark.session import materialise

SHINGLE = 5
#: Two texts link from this similarity on, in tenths.
TENTHS = 8
SLICE_BYTES = 1_000_000
#: Class 0 ends at this part of the hash range.
LOWER = np.uint64(3 << 61)
#: Documents looked at for frequent n-grams (expected number), and the share of them that makes one frequent.
SAMPLED, FREQUENT = 2_000, 0.01
#: N-grams counted in one fragment, and fragments up to which it is the smaller number.
COUNTED, FRAGMENTS = (1 << 18, 1 << 22), 2_048
#: Lists of up to this many nodes are expanded into pairs; in longer ones each node meets so many drawn ones.
PAIRED, CENTRES = 32, 3
#: Pairs of one node that meet its n-grams in one place.
DEALT = 64
#: Fragments of the order in which overlaps are counted, as bits.
OVERLAP_BITS = 2
#: Nodes on each side of a cell, and n-grams of a cell that are multiplied at a time.
CELL, STRIP = 512, 8_192
#: Up to this many rows a lookup of documents is broadcast (some 20 MB), beyond it is shuffled.
BROADCAST_ROWS = 200_000
_MANY = (1 << 31) - 1


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts): text t has the different shingle hashes values[cuts[t]:cuts[t + 1]], in their order."""
    words = words_of(texts)
    word = hashes(words.dictionary)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = words.counts
    sizes = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    owners = np.repeat(np.arange(len(counts)), sizes)
    first = (words.ends - counts)[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value, ends = np.zeros(len(owners), np.uint64), words.ends[owners]
    for i in range(SHINGLE):
        inside = first + i < ends
        value[inside] = mixed(value[inside] + word[first[inside] + i] + np.uint64(i + 1))
    order = np.lexsort((value, owners))
    owners, value = owners[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owners[new], np.arange(len(counts) + 1))


def nodes_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets."""
    found = (xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:]))
    return np.fromiter(found, np.uint64, len(cuts) - 1).view(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """One of the first so many n-grams, in any order, is shared with each partner."""
    return n - (n * TENTHS + 9) // 10 + 1


def order_class(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0, 1 or 2: the class of each n-gram in the global order; ``frequent`` is sorted."""
    out = (values >= LOWER).astype(np.int8)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        out[frequent[at] == values] = 2
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text"))


def frequent_ngrams(docs: DataFrame, total: int) -> np.ndarray:
    """Sorted n-grams of FREQUENT of about SAMPLED documents: at most the mean set size / FREQUENT of them."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(total // SAMPLED, 1))) == 0

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part.column("text"))[0].view(np.int64))], ["value"])

    counted = _texts(docs).where(draw).mapInArrow(ngrams, "value bigint").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    least = max(8, int(min(total, SAMPLED) * FREQUENT))
    found = [r["value"] for r in counted.where(F.col("n") >= least).select("value").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _describe(frequent: np.ndarray) -> Callable:
    """(row, doc_id, node, n, lower): each document's node, set size and n-grams of class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                values, cuts = shingle_sets(part.column("text"))
                before = np.concatenate([[0], np.cumsum(order_class(values, frequent) == 0)])
                columns = [nodes_of(values, cuts), np.diff(cuts), before[cuts[1:]] - before[cuts[:-1]]]
                arrays = [part.column("row"), part.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "node", "n", "lower"])

    return run


_PACKED = "fragment int, ngrams binary, nodes binary"


def _pack(frequent: np.ndarray, fragments: int) -> Callable:
    """All n-grams of class 0 of each node, and the others that its prefix needs, as packed arrays for each fragment.

    Frequent n-grams are packed apart, under numbers from ``fragments`` on, and spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                values, cuts = shingle_sets(part.column("text"))
                nodes, sizes = nodes_of(values, cuts), np.diff(cuts)
                once = np.zeros(len(nodes), bool)
                once[np.unique(nodes, return_index=True)[1]] = True
                owners = np.repeat(np.arange(len(nodes)), sizes)
                values, owners = values[once[owners]], owners[once[owners]]
                kind = order_class(values, frequent)
                order = np.lexsort((values, kind, owners))
                values, owners, kind = values[order], owners[order], kind[order]
                place = np.arange(len(owners)) - np.searchsorted(owners, owners)
                sent = (kind == 0) | (place < prefix_length(sizes)[owners])
                values, owners, kind = values[sent], owners[sent], kind[sent]
                at = ((values >> np.uint64(32)) % np.uint64(fragments)).astype(np.int64)
                at = np.where(kind == 2, fragments + (at + turn) % fragments, at)
                order = np.argsort(at, kind="stable")
                at, values, held = at[order], values[order], nodes[owners[order]]
                found, starts = np.unique(at, return_index=True)
                bounds = [*starts.tolist(), len(at)]
                packed = [[x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] for x in (values, held)]
                arrays = [pa.array(found, pa.int32()), *[pa.array(x, pa.binary()) for x in packed]]
                yield pa.RecordBatch.from_arrays(arrays, ["fragment", "ngrams", "nodes"])
                turn += 1

    return run


def _shared(frequent: np.ndarray, fragments: int) -> Callable:
    """(ngram, node, kind, held) of one fragment, for the n-grams that more than one node holds."""

    def run(rows: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        values, nodes = read("ngrams", np.uint64), read("nodes", np.int64)
        order = np.lexsort((nodes, values))
        values, nodes = values[order], nodes[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1])
        values, nodes = values[new], nodes[new]
        starts = np.concatenate([[True], values[1:] != values[:-1]]).nonzero()[0] if len(values) else np.zeros(0, int)
        counts = np.diff(np.append(starts, len(values)))
        held = np.repeat(counts, counts)
        kind = order_class(values, frequent)
        if rows.num_rows and rows.column("fragment")[0].as_py() >= fragments:  # a part of the nodes only
            held = np.full(len(values), _MANY)
        kept = held > 1
        columns = [values.view(np.int64)[kept], nodes[kept], kind[kept].astype(np.int32), np.minimum(held, _MANY)[kept].astype(np.int32)]
        return pa.table([pa.array(c) for c in columns], names=["ngram", "node", "kind", "held"])

    return run


def _postings(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(ngram, node, n, top): n-grams of the nodes' prefixes that others hold too; ``top`` is a node's most frequent one."""
    prefix = F.col("n") - F.floor((F.col("n") * TENTHS + 9) / 10) + 1
    sent = classes.agg(F.sum(F.greatest("lower", prefix))).first()[0] or 0
    fragments = max(-(-sent // min(max(sent // FRAGMENTS, COUNTED[0]), COUNTED[1])), 1)
    packed = _texts(docs).mapInArrow(_pack(frequent, fragments), _PACKED)
    shared = packed.groupBy("fragment").applyInArrow(_shared(frequent, fragments), "ngram bigint, node bigint, kind int, held int")
    # Copies in several parts of the input send their frequent n-grams more than once.
    single = shared.repartition("node").groupBy("node", "ngram").agg(F.min("kind").alias("kind"), F.max("held").alias("held"))
    each = Window.partitionBy("node")
    ranked = single.withColumns(
        {
            "shared": F.count(F.when(F.col("kind") == 0, 1)).over(each),
            "rank": F.row_number().over(each.orderBy("kind", "held", "ngram")),
        }
    )
    known = classes.select(F.col("node").alias("_node"), "n", "lower")
    ranked = ranked.join(known, ranked["node"] == known["_node"])
    place = F.col("rank") + F.when(F.col("kind") == 0, F.col("lower") - F.col("shared")).otherwise(0)
    inside = ranked.where((F.col("kind") > 0) | (place <= prefix))
    top = F.max(F.struct("held", "ngram")).over(each)["ngram"]
    return materialise(inside.select("ngram", "node", "n", top.alias("top")))


def _lists(postings: DataFrame) -> DataFrame:
    """(ngram, node, n, size, centres): the lists under n-grams of two or more nodes, without those inside of one other list.

    Long lists bring their drawn nodes (node, n) along, found by the same count.
    """
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), "node", "n")).alias(f"c{k}") for k in range(CENTRES)]
    counted = postings.groupBy("ngram").agg(
        F.count(F.lit(1)).alias("size"), F.min("top").alias("least"), F.max("top").alias("most"), F.array(*drawn).alias("drawn")
    )
    inside = (F.col("least") == F.col("most")) & (F.col("least") != F.col("ngram"))
    kept = (F.col("size") > 1) & ~inside
    centres = F.when(kept & (F.col("size") > PAIRED), F.col("drawn"))
    counted = materialise(counted.select("ngram", "size", kept.alias("kept"), centres.alias("centres")))
    found = attach(postings.select("ngram", "node", "n"), counted, ["ngram"], "size", ["size", "kept", "centres"])
    return materialise(found.where("kept").drop("kept"))


def _similar_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 10 >= F.greatest(a, b) * TENTHS


def _pairs(lists: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b: all pairs of short lists; of long ones each node with the drawn ones."""
    short = lists.where(F.col("size") <= PAIRED)
    left = short.select("ngram", F.col("node").alias("a"), F.col("n").alias("of_a"))
    right = short.select("ngram", F.col("node").alias("b"), F.col("n").alias("of_b"))
    paired = left.join(right, "ngram").where("a < b").select("a", "b", "of_a", "of_b")
    met = lists.where(F.col("size") > PAIRED)
    met = met.select("node", "n", F.explode("centres").alias("c")).where(F.col("node") != F.col("c.node"))
    one, other = F.struct("node", "n"), F.struct("c.node", "c.n")
    met = met.select(F.least(one, other).alias("l"), F.greatest(one, other).alias("g"))
    starred = met.select(F.col("l.node").alias("a"), F.col("g.node").alias("b"), F.col("l.n").alias("of_a"), F.col("g.n").alias("of_b"))
    return materialise(paired.unionByName(starred).where(_similar_sizes("of_a", "of_b")).select("a", "b").distinct())


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            values, cuts = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "ngrams"])


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, ngrams) of the wanted nodes, stored; the texts of one row each are read again."""
    named = materialise(classes.join(wanted.distinct(), "node").select("node", F.col("first_row").alias("_row")))
    texts = docs.select(row_digest().alias("row"), text_of().alias("text"))
    lookup = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = texts.join(lookup, texts["row"] == lookup["_row"]).select("node", "text")
    sets = texts.mapInArrow(_set_batches, "node bigint, ngrams array<bigint>")
    return materialise(sets.groupBy("node").agg(F.first("ngrams").alias("ngrams")))  # rows that repeat id and text


def _dealt(pairs: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with a place for one side, and (node, place) for the copies of its sets: one for every DEALT pairs."""
    counts = materialise(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("pairs")))
    place = F.pmod(F.xxhash64("a", "b"), F.floor(F.col("pairs") / DEALT) + 1).alias(f"at_{side}")
    dealt = attach(pairs, counts, [side], "pairs", ["pairs"]).select(*pairs.columns, place)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("pairs") / DEALT))).alias(f"copy_{side}")
    return dealt, counts.select(F.col(side).alias(f"node_{side}"), copies)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose overlaps, counted for each fragment and summed, reach the similarity."""
    fragments = range(1 << OVERLAP_BITS)
    of = lambda i: F.filter("ngrams", lambda x: F.shiftrightunsigned(x, 64 - OVERLAP_BITS) == i)
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("fragment"), of(i).alias("segment")) for i in fragments])).alias("s")
    segments = materialise(sets.select("node", cut).select("node", "s.*").where(F.size("segment") > 0))
    dealt, copies_a = _dealt(pairs, "a")
    dealt, copies_b = _dealt(materialise(dealt), "b")
    met = materialise(dealt).withColumn("fragment", F.explode(F.array(*map(F.lit, fragments))))
    for side, copies in (("a", copies_a), ("b", copies_b)):
        copied = segments.join(copies, segments["node"] == copies[f"node_{side}"]).select(
            f"node_{side}", f"copy_{side}", F.col("fragment").alias(f"fragment_{side}"), F.col("segment").alias(f"of_{side}")
        )
        same = (met[side] == copied[f"node_{side}"]) & (met[f"at_{side}"] == copied[f"copy_{side}"])
        met = met.join(copied, same & (met["fragment"] == copied[f"fragment_{side}"]), "left")
    partial = F.coalesce(F.size(F.array_intersect("of_a", "of_b")), F.lit(0))
    held = F.coalesce(F.size("of_a"), F.lit(0)) + F.coalesce(F.size("of_b"), F.lit(0))
    summed = met.groupBy("a", "b").agg(F.sum(partial).alias("common"), F.sum(held).alias("held"))
    return summed.where(F.col("common") * 10 >= (F.col("held") - F.col("common")) * TENTHS).select("a", "b")


def overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every two sets, summed over strips of the n-grams that both sides have."""
    out = np.zeros((len(one), len(other)), np.float64)
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (one, other)]
    shared = np.intersect1d(flat[0][0], flat[1][0])
    for start in range(0, len(shared), STRIP):
        strip = shared[start : start + STRIP]
        sides = []
        for (values, owners), count in zip(flat, out.shape):
            at = np.minimum(np.searchsorted(strip, values), len(strip) - 1)
            hit = strip[at] == values
            held = np.zeros((count, len(strip)), np.float32)
            held[owners[hit], at[hit]] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def _cell_links(rows: pa.Table) -> pa.Table:
    """One link between the group of each node of the one side and each group of the other that the node links with."""
    outer = rows.column("outer").to_numpy()
    nodes, roots, n = (rows.column(c).to_numpy() for c in ("node", "root", "n"))
    sets = [np.array(s, np.int64) for s in rows.column("ngrams").to_pylist()]
    one, other = np.flatnonzero(outer), np.flatnonzero(~outer)
    found: set[tuple[int, int]] = set()
    if len(one) and len(other):
        common = overlaps([sets[i] for i in one], [sets[i] for i in other])
        union = n[one][:, None] + n[other][None, :] - common
        near = (common * 10 >= union * TENTHS) & (roots[one][:, None] != roots[other][None, :])
        for i, row in zip(one, near):
            at = other[np.flatnonzero(row)]
            at = at[np.unique(roots[at], return_index=True)[1]]
            found |= {(int(roots[i]), int(roots[j])) for j in at}
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _rest(docs: DataFrame, classes: DataFrame, long: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links (a, b) between groups of a list (ngram, node, n), stored: its nodes outside of the largest group meet all others."""
    named = groups.withColumnRenamed("node", "_node").withColumnRenamed("root", "_root")
    rooted = long.join(named, long["node"] == named["_node"], "left").select("ngram", "node", "n", F.coalesce("_root", "node").alias("root"))
    rooted = materialise(rooted)
    per_root = rooted.groupBy("ngram", "root").agg(F.count(F.lit(1)).alias("size"))
    sizes = per_root.groupBy("ngram").agg(
        F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("groups")
    )
    open_lists = materialise(sizes.select("ngram", "size", F.when(F.col("groups") > 1, F.col("largest")).alias("largest")))
    if open_lists.where("largest is not null").isEmpty():
        return None
    members = attach(rooted, open_lists, ["ngram"], "size", ["size", "largest"]).where("largest is not null")
    members = materialise(members)
    outer = F.col("root") != F.col("largest.root")
    down = F.ceil(F.col("size") / CELL).cast("int")
    across = F.ceil((F.col("size") - F.col("largest.size")) / CELL).cast("int")
    # As one of the other side a node meets every part of the outer ones, as an outer one every part of all.
    own = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    member = ["ngram", "node", "root", "n"]
    others = members.select(*member, F.lit(False).alias("outer"), every(across).alias("i"), own(down).alias("j"))
    outers = members.where(outer).select(*member, F.lit(True).alias("outer"), own(across).alias("i"), every(down).alias("j"))
    cells = others.unionByName(outers)
    sets = _sets(docs, classes, members.select("node")).withColumnRenamed("node", "_node")
    held = cells.join(sets, cells["node"] == sets["_node"]).drop("_node")
    found = materialise(held.groupBy("ngram", "i", "j").applyInArrow(_cell_links, "a bigint, b bigint"))
    return None if found.isEmpty() else found


def _node_lists(near: DataFrame, rows: DataFrame) -> DataFrame:
    """(ngram, node, n): the nodes of the rows that pairs (a, b) name by their digests, as one list for each ``a``."""
    known = rows.where("n > 0").select("row", "node", "n").distinct()
    named = near.select("a", F.explode(F.array("a", "b")).alias("row")).distinct()
    return named.join(known, "row").select(F.xxhash64(F.lit("near"), "a").alias("ngram"), "node", "n").distinct()


def jaccard_groups(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, n, root), stored: the digest of each row, its set size and its group (null without words).

    ``near`` names groups of further candidates by pairs (a, b) of row digests, one ``a`` for each group.  A group is a list
    like a long one of an n-gram: nodes of it that are not connected meet all others in the exact similarity.
    """
    docs = whole_texts(docs)
    frequent = frequent_ngrams(docs, docs.count())
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(row_digest().alias("row"), "doc_id", text_of().alias("text"))
    rows = materialise(texts.mapInArrow(_describe(frequent), f"row string, doc_id {kind}, node bigint, n bigint, lower bigint"))
    classes = rows.where("n > 0").groupBy("node").agg(
        F.min("row").alias("first_row"), F.max("n").alias("n"), F.max("lower").alias("lower"), F.count(F.lit(1)).alias("size")
    )
    classes = materialise(classes)
    lists = _lists(_postings(docs, classes, frequent))
    pairs = _pairs(lists)
    long = lists.where(F.col("size") > PAIRED).select("ngram", "node", "n")
    if near is not None:
        long = long.unionByName(_node_lists(near, rows))
    sets = _sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialise(_links(pairs, sets))
    groups = components(links)
    rest = _rest(docs, classes, long, groups)
    named = classes.join(groups, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    if rest is not None:  # links between groups: the groups themselves are the nodes
        joined = components(rest).select(F.col("node").alias("root"), F.col("root").alias("_top"))
        named = named.join(joined, "root", "left").select("node", "size", F.coalesce("_top", "root").alias("root"))
    found = attach(rows.where("n > 0").select("row", "doc_id", "n", "node"), materialise(named), ["node"], "size", ["root"])
    alone = rows.where("n = 0").select("row", "doc_id", "n", F.lit(None).cast("bigint").alias("root"))
    return materialise(found.select("row", "doc_id", "n", "root").unionByName(alone))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = jaccard_groups(docs)
    names = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    found = attach(rows.where("root is not null"), materialise(names), ["root"], "size", ["component_id"])
    found = found.unionByName(rows.where("root is null").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """All columns of one row of each group: the smallest id's, rows without an id last; rows that share an id by their digest."""
    rows = jaccard_groups(docs, near)
    group = F.coalesce(F.col("root").cast("string"), "row").alias("group")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return rows_of(docs, rows.groupBy(group).agg(F.min(order).alias("first")).select("first.row"))
