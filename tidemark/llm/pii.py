"""Personal data: fixed patterns, and identifiers found from their contexts (operator 3).

Base spans are the leftmost non-overlapping matches of one expression per kind
(email, ip, card, phone) that pass the kind's test.  They are the seeds of a
bootstrapped extraction: the words before and after a seed are lexical
patterns, and every other token with digits or an @, or run of digit groups with
single blanks between, that looks like a kind is a candidate instance.  Patterns and instances form a graph that is scored in
rounds: a pattern's confidence is the share of all occurrences of its word, in
the whole corpus, at which an accepted instance stands, other candidates left out; an instance's score
combines its patterns' confidences (1 - product of their complements).
Instances that reach ACCEPTED join the seeds of the next round, and all their
mentions, and those of the seeds' own values, become spans.  All of it is DataFrame work.

Defined cases: a null text is an empty one, without spans; spans of different
kinds may overlap; candidates that overlap a base span are none; a pattern
needs MIN_SUPPORT different accepted values; counts are of base spans; repeated
rows are each reported.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACE, UPPER, WORD, attach, text_of
from tidemark.session import materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
CONFIDENT = 0.5
ACCEPTED = 0.9

# The contract's expressions.  Within a run of the first class a match can only start at the run's first character
# or where the last match ended, so the others are not tried; what cannot be given back is possessive.
_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A text without this character has no match.
_NEEDS = ("@", ".", None, "+")
#: What candidates are cut from: two to five groups of digits with single blanks between, else whole tokens with a
#: digit or an @.
_RUN = r"[(]?[0-9]{2,4}[)]?(?:\x20[0-9]{2,4}(?:-[0-9]{2,4})?(?![0-9A-Za-z@])){1,4}+"
_TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{_RUN}|[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+)"
_CONTEXT = 60
_CANDIDATE = len(KINDS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def passes(kind: Column, value: Column) -> Column:
    """The test of each kind on a match of its expression."""
    digits = _digits(value)
    size = F.length(digits)
    parts = F.split(value, r"\.")
    small = F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        parts, lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255
    )
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, small)
        .when(kind == 2, (size >= 14) & (size <= 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, (size >= 10) & (size <= 15))
        .otherwise(False)
    )


def _lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def _described(number: int) -> Column:
    """(kind, nth, gap, value, before, after) of every match; ``gap`` code points lie between it and the one before."""
    pieces = F.col(f"pieces{number}")

    def described(value: Column, nth: Column) -> Column:
        ahead, behind = F.get(pieces, nth), F.get(pieces, nth + 1)
        before = F.regexp_extract(F.right(ahead, F.lit(_CONTEXT)), rf"({WORD}){SPACE}*$", 1)
        after = F.regexp_extract(F.left(behind, F.lit(_CONTEXT)), rf"^{SPACE}*({WORD})", 1)
        return F.struct(
            F.lit(number).alias("kind"),
            nth.cast("int").alias("nth"),
            F.char_length(ahead).cast("bigint").alias("gap"),
            value.alias("value"),
            _lower(before).alias("before"),
            _lower(after).alias("after"),
        )

    return F.transform(f"found{number}", described)


def scan(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, found) of every document, stored: all matches and tokens, none tested yet.

    The only pass over the texts' positions; everything after it works on the
    few matches.  Matches and the pieces between them are columns of their own
    before they are described: inside the description they would be cut anew
    for each match.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("uid", F.monotonically_increasing_id())
    text, none = F.col("text"), F.array().cast("array<string>")
    expressions = [*zip(EXPRESSIONS, _NEEDS), (_TOKEN, None)]
    found, pieces = {}, {}
    for i, (expression, needs) in enumerate(expressions):
        matches = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
        found[f"found{i}"] = matches if needs is None else F.when(F.instr(text, needs) > 0, matches).otherwise(none)
        pieces[f"pieces{i}"] = F.when(F.size(f"found{i}") > 0, F.split(text, expression, -1)).otherwise(none)
    cut = rows.withColumns(found).withColumns(pieces)
    described = [_described(i) for i in range(len(expressions))]
    return materialise(cut.select("uid", "doc_id", F.concat(*described).alias("found")))


def mentions(scanned: DataFrame) -> DataFrame:
    """(uid, kind, start, end, value, before, after): base spans and, as the last kind, candidate tokens."""
    rows = scanned.select("uid", F.explode("found").alias("m")).select("uid", "m.*")
    # One text's matches of one kind.
    earlier = Window.partitionBy("uid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("value")
    end = F.sum(F.col("gap") + length).over(earlier)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - length)
    return placed.where((F.col("kind") == _CANDIDATE) | passes(F.col("kind"), F.col("value")))


def _candidate_kind(value: Column) -> Column:
    """The kind a token looks like, or null."""
    size = F.length(_digits(value))
    numeric = value.rlike(r"^[+(]?[0-9][0-9().\x20-]*$")
    return (
        F.when(value.rlike(r"^[^@]+@[^@]+$"), 0)
        .when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1)
        .when(numeric & (size >= 12) & (size <= 19), 2)
        .when(numeric & (size >= 7) & (size <= 11), 3)
    )


def split_mentions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans, and candidates (with the kind they look like) that overlap none of them."""
    base = found.where(F.col("kind") != _CANDIDATE)
    # Punctuation around a token is not part of it.
    head = F.char_length(F.regexp_extract("value", r"^[^0-9A-Za-z+(@]*", 0))
    tail = F.char_length(F.regexp_extract(F.reverse("value"), r"^[^0-9A-Za-z]*+", 0))
    core = F.substring(F.col("value"), head + 1, F.char_length("value") - head - tail)
    trimmed = found.where(F.col("kind") == _CANDIDATE).withColumns(
        {"start": F.col("start") + head, "end": F.col("end") - tail, "value": core}
    )
    trimmed = trimmed.where(F.char_length("value") <= _CONTEXT).withColumn("looks", _candidate_kind(F.col("value")))
    candidates = trimmed.where(F.col("looks").isNotNull())
    both = base.withColumn("looks", F.lit(None).cast("int")).unionByName(candidates)
    own = F.col("kind") != _CANDIDATE
    up_to = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    marked = both.withColumns(
        {"reached": F.max(F.when(own, F.col("end"))).over(up_to), "next": F.min(F.when(own, F.col("start"))).over(beyond)}
    )
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    candidates = marked.where((F.col("kind") == _CANDIDATE) & free).drop("reached", "next", "kind")
    return base, candidates.withColumnRenamed("looks", "kind")


def graph(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges (kind, value, side, word, n, seed) between instances and patterns, copies folded."""
    both = base.select("kind", "value", "before", "after", F.lit(1).alias("seed")).unionByName(
        candidates.select("kind", "value", "before", "after", F.lit(0).alias("seed"))
    )
    sides = F.array(
        F.struct(F.lit("L").alias("side"), F.col("before").alias("word")),
        F.struct(F.lit("R").alias("side"), F.col("after").alias("word")),
    )
    edges = both.select("kind", "value", "seed", F.explode(sides).alias("p")).select("kind", "value", "seed", "p.*")
    folded = edges.where(F.col("word") != "").groupBy("kind", "value", "side", "word")
    return folded.agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))


def word_occurrences(docs: DataFrame) -> DataFrame:
    """(word, occurrences) over all texts, words as the patterns have them."""
    words = F.explode(F.split(_lower(text_of()), f"{SPACE}+"))
    return docs.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))


def bootstrap(edges: DataFrame, occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, score) of the instances that are accepted, seeds included; ``edges`` is a stored table."""
    # Only words beside at least MIN_SUPPORT instances can become patterns.
    words = edges.groupBy("kind", "side", "word").agg(F.count(F.lit(1)).alias("instances"))
    usable = words.where(F.col("instances") >= MIN_SUPPORT)
    usable = materialise(usable.join(occurrences, "word").select("kind", "side", "word", "instances", "occurrences"))
    state = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        accepted = F.col("score") >= ACCEPTED
        hits = state.groupBy("kind", "side", "word").agg(
            F.sum(F.when(accepted, F.col("n") * F.col("score")).otherwise(0.0)).alias("hits"),
            F.count(F.when(accepted, 1)).alias("support"),
            F.sum("n").alias("mentions"),
            F.count(F.lit(1)).alias("edges"),
        )
        # Candidates that are not accepted speak neither for a pattern nor against it.
        judged = F.col("hits") + F.greatest(F.col("occurrences") - F.col("mentions"), F.lit(0))
        rated = hits.join(usable.drop("instances"), ["kind", "side", "word"], "left").withColumn(
            "confidence",
            F.when(
                (F.col("support") >= MIN_SUPPORT) & (F.col("hits") >= CONFIDENT * judged),
                F.least(F.col("hits") / judged, F.lit(0.999)),
            ).otherwise(0.0),
        )
        linked = materialise(attach(state, materialise(rated), ["word", "side", "kind"], "edges", ["confidence"]))
        scores = linked.groupBy("value", "kind").agg(
            F.max("seed").alias("is_seed"),
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("combined"),
            F.count(F.lit(1)).alias("edges"),
        )
        scores = scores.select(
            "value", "kind", "edges", F.when(F.col("is_seed") == 1, 1.0).otherwise(F.col("combined")).alias("score")
        )
        state = materialise(
            attach(edges, materialise(scores), ["value", "kind"], "edges", ["score"])
        )
    # A seed's value is accepted wherever it stands, also where the base expression did not take it.
    return state.where(F.col("score") >= ACCEPTED).groupBy("kind", "value").agg(F.max("score").alias("score"))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (uid, doc_id, ...), and their spans (uid, kind, start, end, value, is_base)."""
    scanned = scan(docs)
    base, candidates = split_mentions(materialise(mentions(scanned)))
    base, candidates = materialise(base), materialise(candidates)
    edges = materialise(graph(base, candidates))
    accepted = bootstrap(edges, word_occurrences(docs))
    accepted = materialise(accepted.withColumn("new", F.lit(True)))
    sized = materialise(
        candidates.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).join(accepted, ["kind", "value"], "left")
    )
    added = attach(candidates, sized, ["value", "kind"], "n", ["new"]).where("new")
    fields = ["uid", "kind", "start", "end", "value"]
    spans = base.select(*fields, F.lit(True).alias("is_base")).unionByName(added.select(*fields, F.lit(False).alias("is_base")))
    return scanned, spans


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.sort_array(spans), text), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, a digest of them, and all spans as text."""
    scanned, spans = find_spans(docs)
    span = F.struct("start", "kind", "end")
    own = F.col("is_base")
    per_text = spans.groupBy("uid").agg(
        *[F.count(F.when(own & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.collect_list(F.when(own, span)).alias("base"),
        F.collect_list(span).alias("every"),
    )
    rows = scanned.select("uid", "doc_id").join(per_text, "uid", "left")
    empty = lambda c: F.coalesce(_joined(F.col(c)), F.lit(""))
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(empty("base").cast("binary"), 256).alias("base_sha256"),
        empty("every").alias("spans"),
    )
