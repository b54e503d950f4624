"""Personal data by bootstrapped contextual extraction.

Base patterns (email, ip, card, phone) give seed entities; long tokens that mix
letters and digits, as keys and secrets do, are seeds as well, but are not reported
for their shape alone. The text beside seeds induces lexical patterns: the label
before an instance (``password=``) or the two words before or behind it. Other
tokens of an identifier's shape are the instances that patterns may extract.

Patterns and instances form a graph that is scored in rounds until nothing more
becomes known. A pattern's confidence is the share of known instances among all
places where the corpus has the pattern, whatever stands there, so words that stand
beside everything never become patterns; it also needs ``min_support`` different
known instances, and those found in earlier rounds count. Pairs of words, unlike
labels, must stand beside a share of all instances as well (``min_share``): by
chance alone each common pair would, in a large corpus, stand beside some. An instance becomes known
when patterns on both sides, or a label, extract it with enough confidence; all its
occurrences become spans of kind ``other``. Base spans are never changed.

Everything is native. The graph holds identifier-shaped tokens only, and its edges
are (pattern, instance, places), aggregated before they are shuffled. Patterns are
counted in one narrow pass over the texts and met there by broadcast while they are
few (counted first).

Edge cases: a null text counts as empty; an empty one has no spans; rows with
equal ``doc_id`` and text get equal results; an empty table gives no rows; a
column named as one of the results is not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialise, single_spaces, small_side, text_or_empty, word_grams

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"

# The contract's patterns, with starts fixed to where a run begins (or the last
# match ended) and without backtracking, so that long runs cost linear time.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
# Groups of digits, or a token of at least six characters with a digit.
_TOKEN = "A-Za-z0-9_-"
CANDIDATE = (
    rf"(?<![{_TOKEN}])(?:[0-9]{{2,}}+(?:[ ./-][0-9]{{2,}}+)++(?![{_TOKEN}])|(?=[A-Za-z_-]*+[0-9])[{_TOKEN}]{{6,}}+)"
)
#: The shape of keys and secrets: 16 characters at least, three letters and three digits among them.
SECRET = rf"^(?=(?:[^0-9]*+[0-9]){{3}})(?=(?:[^A-Za-z]*+[A-Za-z]){{3}})[{_TOKEN}]{{16,}}$"
#: Marks that make what stands before them a label.
LABEL = r"[=:#(\[{<&?/\\|\x22\x27]"
#: Stands for the start and the end of a text.
EDGE = "\x01"

MIN_SUPPORT = 5
#: Share of the different instances that a pair of words must stand beside.
MIN_SHARE = 0.002
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.95
#: Confidence at which a label alone extracts.
MIN_LABEL = 0.9
#: Different patterns that are sent to every executor at most.
BROADCAST_PATTERNS = 500_000


def units(text: Column) -> Column:
    """Lower-case words with the marks behind them, parted by single spaces; white space beside marks does not count."""
    out = F.regexp_replace(F.lower(text), rf"[{WS}]++(?=[^\p{{L}}\p{{N}}_{WS}{EDGE}])", "")
    out = F.regexp_replace(out, rf"([^\p{{L}}\p{{N}}_{WS}{EDGE}])(?=[\p{{L}}\p{{N}}_])", "$1 ")
    return F.btrim(single_spaces(out), F.lit(" "))


def _left(before: Column) -> Column:
    """The pattern that the text before an instance makes: a label, or else the last two words."""
    own = units(F.concat(F.lit(EDGE + " "), before))
    last = F.substring_index(own, " ", -1)
    return F.concat(F.lit("L:"), F.when(last.rlike(LABEL), last).otherwise(F.substring_index(own, " ", -2)))


def _right(behind: Column) -> Column:
    """The next two words; marks directly behind the instance belong to it."""
    own = units(F.concat(F.regexp_replace(behind, r"^[^\p{L}\p{N}_]++", ""), F.lit(" " + EDGE)))
    return F.concat(F.lit("R:"), F.substring_index(own, " ", 2))


def _prefix_sums(numbers: str, block: int = 256) -> str:
    """SQL: sums of the numbers before each place; two levels, so long arrays cost little."""
    n_blocks = f"cast(ceil(size({numbers}) / {block}.0) as int)"
    inner = (
        f"transform(sequence(0, {n_blocks} - 1), b -> aggregate(slice({numbers}, b * {block} + 1, {block}),"
        " named_struct('at', 0L, 'out', cast(array() as array<bigint>)),"
        " (s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at))))"
    )
    return (
        f"case when size({numbers}) = 0 then cast(array() as array<bigint>) else"
        f" aggregate({inner}, named_struct('at', 0L, 'out', cast(array() as array<array<bigint>>)),"
        " (s, x) -> named_struct('at', s.at + x.at, 'out', array_append(s.out, transform(x.out, y -> y + s.at))),"
        " s -> flatten(s.out)) end"
    )


def _matches(rows: DataFrame, name: str, pattern: str, gate: Column, contexts: bool) -> DataFrame:
    """Add ``name``: start, end and text of each match, with ``contexts`` also the patterns left and right of it."""
    found, between = f"_{name}_found", f"_{name}_between"
    rows = rows.withColumn(
        found,
        F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(
            F.array().cast("array<string>")
        ),
    ).withColumn(
        between,
        F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn(
        f"_{name}_steps",
        F.expr(f"transform({found}, (x, i) -> cast(length(x) + length({between}[i]) as bigint))"),
    ).withColumn(f"_{name}_before", F.expr(_prefix_sums(f"_{name}_steps")))
    parts, gaps = F.col(found), F.col(between)

    def match(x: Column, i: Column) -> Column:
        start = F.col(f"_{name}_before")[i] + F.length(gaps[i])
        out = [start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text")]
        if contexts:
            # What lies between two matches, and the matches themselves.
            ahead = F.concat(F.when(i > 0, parts[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit("")), gaps[i])
            last = F.size(parts) - 1
            behind = F.concat(gaps[i + 1], F.when(i < last, parts[F.least(i + 1, last)]).otherwise(F.lit("")))
            out += [_left(ahead).alias("left"), _right(behind).alias("right")]
        return F.struct(*out)

    return rows.withColumn(name, F.transform(parts, match)).drop(found, between, f"_{name}_steps", f"_{name}_before")


def base_spans(docs: DataFrame, *carried: str, contexts: bool = False) -> DataFrame:
    """Per row of ``docs``: spans of each kind; with ``contexts`` also the patterns beside them, and further candidates."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"), *carried)
    digits = F.col("text").rlike("[0-9]")
    rows = _matches(rows, "email", PATTERNS["email"], F.contains("text", F.lit("@")), contexts)
    rows = _matches(rows, "ip", PATTERNS["ip"], digits, contexts)
    rows = _matches(rows, "card", PATTERNS["card"], digits, contexts)
    rows = _matches(rows, "phone", PATTERNS["phone"], F.contains("text", F.lit("+")), contexts)
    if contexts:
        rows = _matches(rows, "token", CANDIDATE, digits, contexts)
    n_digits = "length(regexp_replace(x.text, '[^0-9]', ''))"
    luhn = (
        "aggregate(sequence(1, length({0})), 0, (a, i) -> a + case when i % 2 = 1"
        " then cast(substring({0}, length({0}) - i + 1, 1) as int)"
        " else 2 * cast(substring({0}, length({0}) - i + 1, 1) as int)"
        " - 9 * cast(cast(substring({0}, length({0}) - i + 1, 1) as int) > 4 as int) end) % 10 = 0"
    ).format("regexp_replace(x.text, '[^0-9]', '')")
    ip_ok = _IP_OK.replace("\\", "\\\\")
    checks = {
        "email": "true",
        "ip": f"x.text rlike '{ip_ok}'",
        "card": f"case when {n_digits} between 12 and 19 then {luhn} else false end",
        "phone": f"{n_digits} between 9 and 15",
    }
    for kind, check in checks.items():
        if check != "true":
            rows = rows.withColumn(kind, F.expr(f"filter({kind}, x -> {check})"))
    if contexts:
        # Tokens that touch a base span are no candidates, unless it is a smaller one inside (digits of a key
        # may pass as a card); nor are those of few digits in groups.
        inside = "x.start <= b.start and b.end <= x.end and b.end - b.start < x.end - x.start"
        apart = " and ".join(f"not exists({kind}, b -> b.start < x.end and x.start < b.end and not ({inside}))" for kind in KINDS)
        rows = rows.withColumn("token", F.expr(f"filter(token, x -> length(x.text) >= 6 and {apart})"))
    return rows


def base_array() -> Column:
    """The spans of all kinds in one array: start, rank of the kind, kind, end."""
    parts = (
        f"transform({k}, x -> struct(x.start as start, {i} as rank, '{k}' as kind, x.end as end))" for i, k in enumerate(KINDS)
    )
    return F.expr(f"concat({', '.join(parts)})")


def _digest(spans: str) -> Column:
    return F.expr(
        f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    )


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, total)``: places where the corpus has each pattern, whatever stands beside it."""
    grams = word_grams("units", 2)
    rows = docs.select(units(F.concat(F.lit(EDGE + " "), text_or_empty().cast("string"), F.lit(" " + EDGE))).alias("units"))
    rows = rows.select(F.explode_outer(grams).alias("gram"))
    # A pair counts for both sides; its first word for the left alone, where it is a label.
    first = F.substring_index("gram", " ", 1)
    keys = F.when(first.rlike(LABEL), F.array(F.col("gram"), first)).otherwise(F.array("gram"))
    rows = rows.select(F.explode_outer(keys).alias("key"))
    wanted = patterns.select("pattern", F.substring("pattern", 3, 1 << 30).alias("key"))
    return rows.join(small_side(wanted, BROADCAST_PATTERNS), "key").groupBy("pattern").agg(F.count("*").alias("total"))


def extract(
    docs: DataFrame,
    max_rounds: int | None = None,
    min_support: int = MIN_SUPPORT,
    min_share: float = MIN_SHARE,
    min_confidence: float = MIN_CONFIDENCE,
    min_score: float = MIN_SCORE,
    min_label: float = MIN_LABEL,
) -> DataFrame:
    """``(doc_id, text_hash, base, more)``: base spans and those that bootstrapping adds, each ``(start, rank, kind, end)``.

    Rounds go on until nothing more is found, or up to ``max_rounds``.
    """
    rows = base_spans(docs, contexts=True)
    context = "struct(lower(x.text) as instance, x.left as left, x.right as right, {} as known, {} as listed)"
    seeds = f"transform(concat({', '.join(KINDS)}), x -> {context.format('true', 'false')})"
    secret = SECRET.replace("\\", "\\\\")
    tokens = f"transform(token, x -> {context.format(f'x.text rlike {chr(39)}{secret}{chr(39)}', 'true')})"
    rows = materialise(
        rows.select(
            "doc_id",
            F.xxhash64("doc_id", "text").alias("text_hash"),
            base_array().alias("base"),
            F.expr(f"concat({seeds}, {tokens})").alias("seen"),
            F.expr("transform(token, x -> struct(x.start as start, x.end as end, lower(x.text) as instance))").alias("token"),
        ),
        "spans",
    )
    # Edges of the graph: how often a pattern stands beside an instance. A pattern needs a letter.
    sides = F.filter(F.array("x.left", "x.right"), lambda p: p.rlike(r"^..*\p{L}"))
    edges = (
        rows.select(F.explode("seen").alias("x"))
        .select("x.instance", "x.known", "x.listed", F.explode(sides).alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.count("*").alias("places"), F.max("known").alias("known"), F.max("listed").alias("listed"))
    )
    edges = materialise(edges, "contexts")
    n_instances = edges.agg(F.count_distinct("instance")).first()[0]
    label = F.col("pattern").startswith("L:") & ~F.contains("pattern", F.lit(" "))
    least = F.when(label, min_support).otherwise(max(min_support, min_share * n_instances))
    common = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    totals = materialise(pattern_totals(docs, materialise(common, "patterns")), "totals")
    edges = materialise(edges.join(totals, "pattern"), "edges")
    found = None
    before = 0
    for done in itertools.count(1):
        known = edges if found is None else edges.join(found.select("instance", F.lit(True).alias("found")), "instance", "left")
        told = F.col("known") if found is None else F.col("known") | F.coalesce("found", F.lit(False))
        confidence = (
            known.filter(told)
            .groupBy("pattern")
            .agg(F.count("*").alias("support"), F.sum("places").alias("places"), F.max("total").alias("total"))
            .select("pattern", "support", (F.col("places") / (F.col("total") + 1)).alias("confidence"))
            .filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
        )
        scores = (
            edges.filter("listed")
            .select("instance", "pattern")
            .join(confidence, "pattern")
            .groupBy("instance")
            .agg(
                (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"),
                F.count_distinct(F.substring("pattern", 1, 1)).alias("sides"),
                F.coalesce(F.max(F.when(label, F.col("confidence"))), F.lit(0.0)).alias("label"),
            )
            .filter(((F.col("score") >= min_score) & (F.col("sides") > 1)) | (F.col("label") >= min_label))
            .select("instance")
        )
        # What is known stays known, so the rounds come to an end, however many they are.
        scores = scores if found is None else scores.unionByName(found).distinct()
        found = materialise(scores, "scores")
        now = found.count()
        if now == before or done == max_rounds:
            break
        before = now
    more = (
        rows.select("doc_id", "text_hash", F.explode("token").alias("x"))
        .select("doc_id", "text_hash", "x.*")
        .join(small_side(found), "instance")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(
                F.struct(
                    F.col("start"), F.lit(len(KINDS)).alias("rank"), F.lit(OTHER).alias("kind"), F.col("end")
                )
            ).alias("more")
        )
    )
    more = materialise(more, "more").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.select("doc_id", "text_hash", "base").join(more, same, "left").drop("_id", "_hash")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of each kind, a digest of the base spans and all spans."""
    found = extract(docs, **options)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.withColumn(
        "every", F.expr("case when more is null then base else concat(base, more) end")
    ).select(
        "doc_id",
        *counts,
        F.sha2(_digest("base").cast("binary"), 256).alias("base_sha256"),
        _digest("every").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_other"),
        F.size("every").cast("long").alias("n_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind; of overlapping spans the first wins and the rest is covered."""
    state = "named_struct('at', cast(0 as bigint), 'out', '')"
    lead = F.aggregate(
        spans,
        F.expr(state),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"].cast("long")).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")))
            .otherwise(s["out"])
            .alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return lead
