"""Personal data: base expressions, then bootstrapped contextual extraction.

Only DataFrame and SQL functions are used.

1. *Seeds.*  Four expressions find e-mail addresses, IPs, card and phone numbers
   (leftmost, non-overlapping per kind; failing matches are dropped).  They are
   written so that the JVM's matcher runs in linear time and constant stack, and
   run only on texts that hold a character without which they cannot match.
   Seeds of a fifth kind, secret, are runs of at least ``SECRET_LENGTH`` ASCII
   letters and digits with ``SECRET_MARKS`` of each, so that neither words nor
   numbers are among them: keys, tokens and digests.  Weaker strings are secrets
   only where the graph accepts them.
2. *Instances.*  Every other run of letters and digits with a digit in it, digit
   group, and string with an at-sign or colons is an instance of no kind yet.
3. *Patterns.*  What stands around a seed or instance, lower-cased and without
   white space, is a lexical pattern: the word before with the marks in between
   (``password=``, ``helpline:``), the two words before, and the word after.
4. *Graph.*  A pattern's score for a kind is the share of the seeds and accepted
   instances of that kind among all seeds and instances beside it, if they have
   ``MIN_SUPPORT`` distinct values.  An instance whose shape suits the kind
   believes the noisy-or of its patterns of at least ``CONFIDENCE``; instances
   that believe as much are accepted with all their occurrences, and so induce
   patterns in the next of ``ROUNDS`` rounds.
5. Secrets and accepted instances are added; base spans stay, and additions never
   overlap them.  Of two kinds that an instance believes equally, the later in the
   alphabet counts.

The numbers of patterns, instances and values grow with the corpus, so all are
met by shuffle joins on counted edges, dealt by a salt where a key may be frequent.

Edge cases: null and empty texts have no spans; repeated rows are reported one
by one and equal rows alike; an empty table gives an empty result; other
columns are ignored by `report` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

MIN_SUPPORT = 3
SALTS = 16
CONFIDENCE = 0.6
ROUNDS = 3
SECRET_LENGTH = 24
SECRET_MARKS = 12
CONTEXT = 64  # characters on either side in which a pattern must lie
KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"

_LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    # \G: a match may also begin in the middle of a run, where the one before ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"[0-9(][0-9()./\x20-]{5,}[0-9](?![A-Za-z0-9])|[^\s@<>]++@[^\s@<>]++|[^\s<>\[\]()]++[\[(]at[\])][^\s<>\[\]()]++|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]++",
}
_DIGIT = "text RLIKE '[0-9]'"
_SCREENS = {"email": "instr(text, '@') > 0", "ip": _DIGIT, "card": _DIGIT, "phone": "instr(text, '+') > 0", "other": "text RLIKE '[0-9@]|[(\\\\[]at[\\\\])]'"}
_RANK = {k: n for n, k in enumerate((*KINDS, ADDED))}


def _digits(value: str) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: str) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return F.col(value).rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _suits(kind: str, value: str) -> Column:
    """Whether the shape of an instance allows the kind."""
    kind, n, letters = F.col(kind), F.length(_digits(value)), F.col(value).rlike("[A-Za-z]")
    at, colons = F.col(value).rlike(r"@|[\[(]at[\])]"), F.col(value).rlike(":")
    plain = ~at & ~colons & ~letters
    return (
        F.when(kind == "email", at)
        .when(kind == "ip", colons | F.col(value).rlike(r"^[0-9]+(?:\.[0-9]+){3,}$"))
        .when(kind == "card", plain & n.between(12, 19))
        .when(kind == "phone", plain & n.between(7, 15))
        .otherwise(~at & ~colons & letters & (F.length(value) >= 6) & F.col(value).rlike("^[A-Za-z0-9]+$"))
    )


def matches(docs: DataFrame) -> DataFrame:
    """One row a document: row number, doc_id, the raw matches of each expression and, if there are any, the text.

    A match array has (gap, value, before, label, after): the characters between
    the match and the one before it, the matched text, and the word, the two
    words and the next word around it, with the marks between.
    """
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, rule in EXPRESSIONS.items():
        rule = rule.replace("\\", "\\\\")
        out = out.withColumn(f"{kind}_gaps", F.expr(f"if({_SCREENS[kind]}, split(text, '{rule}', -1), array(''))"))
        out = out.withColumn(f"{kind}_values", F.expr(f"if(size({kind}_gaps) > 1, regexp_extract_all(text, '{rule}', 0), array())"))
    word, marks = r"[\\p{L}_]+", r"[^\\p{L}\\p{N}_]{0,4}"
    near = lambda x, rule: f"lower(regexp_replace(regexp_extract({x}, '{rule}', 0), '\\\\s', ''))"
    row = []
    for kind in EXPRESSIONS:
        left, right = f"right({kind}_gaps[i], {CONTEXT})", f"left({kind}_gaps[i + 1], {CONTEXT})"
        row.append(F.expr(
            f"transform({kind}_values, (v, i) -> named_struct('gap', length({kind}_gaps[i]), 'value', v, 'before', {near(left, word + marks + '$')}, "
            f"'label', {near(left, word + marks + word + marks + '$')}, 'after', {near(right, '^' + marks + word)}))"
        ).alias(kind))
    any_match = F.greatest(*[F.size(k) for k in EXPRESSIONS]) > 0
    return out.select("row", "doc_id", *row, F.when(any_match, F.col("text")).alias("text"))


_SPAN = ["row", "kind", "start", "stop", "value", "before", "label", "after"]


def _spans(found: DataFrame, kind: str) -> DataFrame:
    """(row, kind, start, stop, value, before, label, after) of the valid matches of an expression."""
    one = found.filter(F.size(kind) > 0).select("row", F.posexplode(kind).alias("k", "m")).select("row", "k", "m.*")
    so_far = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(so_far))
    one = one.withColumn("start", F.col("stop") - F.length("value"))
    return one.filter(_valid(kind, "value")).withColumn("kind", F.lit(kind)).select(*_SPAN)


def _secret(value: str) -> Column:
    count = lambda marks: F.length(F.regexp_replace(value, f"[^{marks}]", ""))
    return F.col(value).rlike(f"^[A-Za-z0-9]{{{SECRET_LENGTH},}}$") & (count("0-9") >= SECRET_MARKS) & (count("A-Za-z") >= SECRET_MARKS)


def _dealt(rows: DataFrame, few: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """`rows` joined with `few`: the rows of a key are dealt to SALTS partitions by the columns `by`."""
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def context_edges(spans: DataFrame) -> DataFrame:
    """(side, word, value, seed, n) of spans with kind: how often a value, a seed of that kind or of none, stands at a pattern."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("before", "label", "after")])
    one = spans.select("value", F.col("kind").alias("seed"), F.explode(sides).alias("c")).select("value", "seed", "c.side", "c.word").filter("word <> ''")
    return one.groupBy("side", "word", "value", "seed").agg(F.count("*").alias("n"))


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((kind, side, word, score) of the last round's good patterns, (kind, value, belief) of the instances accepted in any)."""
    total = stash(edges.groupBy("side", "word").agg(F.sum("n").alias("total")), "pii-totals")
    seeds = edges.filter("seed IS NOT NULL").select("side", "word", "value", F.col("seed").alias("kind"), "n")
    open_edges = edges.filter("seed IS NULL").select("side", "word", "value", "n")
    accepted = good = None
    for _ in range(rounds):
        known = seeds if accepted is None else seeds.unionByName(_dealt(open_edges, accepted.select("value", "kind"), ["value"], ["side", "word"]))
        support = known.groupBy("kind", "side", "word").agg(F.sum("n").alias("mine"), F.count_distinct("value").alias("distinct_values")).filter(F.col("distinct_values") >= MIN_SUPPORT)
        score = support.join(total, ["side", "word"]).select("kind", "side", "word", (F.col("mine") / F.col("total")).alias("score"))
        good = stash(score.filter(F.col("score") >= CONFIDENCE), "pii-patterns")
        at = _dealt(open_edges, good, ["side", "word"], ["value"]).filter(_suits("kind", "value"))
        belief = at.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
        best = belief.groupBy("value").agg(F.max(F.struct("belief", F.col("kind"))).alias("b")).select("value", "b.kind", "b.belief").filter(F.col("belief") >= CONFIDENCE)
        accepted = stash(best if accepted is None else best.unionByName(accepted).groupBy("value").agg(F.max_by("kind", "belief").alias("kind"), F.max("belief").alias("belief")), "pii-accepted")
    return good, accepted


def discover(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Spans (row, kind, start, stop, induced) that secrets and, induced, accepted instances add to the base seeds."""
    base = seeds.select("row", F.col("start").alias("a"), F.col("stop").alias("z"))
    other = _spans(found, "other")
    free = other.join(base, (other["row"] == base["row"]) & (F.col("start") < F.col("z")) & (F.col("a") < F.col("stop")), "left_anti")
    free = stash(free.withColumn("kind", F.when(_secret("value"), ADDED)), "pii-instances")
    edges = stash(context_edges(seeds.unionByName(free)), "pii-edges")
    _, accepted = score_graph(edges)
    columns = ["row", "kind", "start", "stop"]
    named = _dealt(free.filter("kind IS NULL").drop("kind"), accepted.select("value", "kind"), ["value"], ["row", "start"])
    return free.filter("kind IS NOT NULL").select(*columns, F.lit(False).alias("induced")).unionByName(named.select(*columns, F.lit(True).alias("induced")))


def _span_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, spans): all documents, and base and added spans with `base` true or false."""
    found = stash(matches(docs), "pii-matches")
    seeds = _spans(found, KINDS[0])
    for kind in KINDS[1:]:
        seeds = seeds.unionByName(_spans(found, kind))
    seeds = stash(seeds, "pii-seeds")
    columns = ["row", "kind", "start", "stop"]
    added = discover(found, seeds)
    return found, seeds.select(*columns, F.lit(True).alias("base"), F.lit(False).alias("induced")).unionByName(added.select(*columns, F.lit(False).alias("base"), "induced"))


def _listed(spans: Column) -> Column:
    """kind:start:stop of each span, by kind as listed, then start; comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_induced of every row; kinds that are added (secret) come after the listed ones, n_induced of the added spans come from the graph."""
    found, spans = _span_lists(docs)
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in _RANK.items()]).alias("rank")
    span = F.struct(rank, "start", "stop", "kind")
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    per_row = spans.groupBy("row").agg(*counts, F.collect_list(span).alias("all"), F.collect_list(F.when(F.col("base"), span)).alias("base_spans"), F.count_if(~F.col("base")).alias("n_added"), F.count_if("induced").alias("n_induced"))
    rows = found.select("row", "doc_id").join(per_row, "row", "left")
    zero = F.lit(0).cast("long")
    listed = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("all").alias("spans"), F.coalesce("n_added", zero).alias("n_added"), F.coalesce("n_induced", zero).alias("n_induced"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; other columns unchanged.

    Spans go back to their rows by doc_id and the whole text, not by a digest.
    """
    found, spans = _span_lists(docs)
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind"))).alias("__found"))
    by_text = found.select("row", F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(by_row, "row").drop("row").dropDuplicates(["__id", "__text"])
    # spans of different kinds may overlap: a piece starts where all spans before it have ended
    by_text = by_text.withColumn("__reach", F.expr("transform(__found, (s, i) -> if(i = 0, 0L, array_max(transform(slice(__found, 1, i), x -> x.stop))))"))
    marked = docs.join(by_text, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["text"] == F.col("__text")), "left")
    pieces = F.expr(
        "concat(array_join(transform(__found, (s, i) -> concat("
        "if(s.start >= __reach[i], substring(__text, cast(__reach[i] + 1 as int), cast(s.start - __reach[i] as int)), ''), "
        "if(s.start >= __reach[i], concat('<', s.kind, '>'), ''))), ''), "
        "substring(__text, cast(array_max(transform(__found, s -> s.stop)) + 1 as int)))"
    )
    return marked.withColumn("text", F.when(F.col("__found").isNull(), docs["text"]).otherwise(pieces)).select(*docs.columns)
