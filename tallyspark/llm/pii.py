"""Personal data by weak supervision, in DataFrame operations only.

1. Each kind has a pattern. Splitting a text at the matches gives the gaps between them, so the
   offsets are running sums of gaps and matches; a text is read, never shuffled.
2. Matches of the four base kinds that pass their test are kept as they are. They and the wider
   candidates (names after a form of address, numbers with separators, long secrets) are put before
   labelers: patterns, gazetteers and context words, each voting yes, no or nothing.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
   is. The counts are a few hundred rows at most, whatever the input.
4. The posteriors train the final span classifier, a naive Bayes model over the shape, length and
   surroundings of a span; its soft counts are one grouped sum. Candidates it accepts are added
   where they don't overlap a base span.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "number", "secret")
# The possessive forms match what the plain ones do, in time and stack that don't grow with the
# square or depth of a run; \G lets a match start where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20[A-ZÀ-Þ][\w'-]++(?:\x20[A-ZÀ-Þ][\w'-]++)?",
    "number": r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,7}){2,5}+(?![\w-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "name": None, "number": r"[0-9]", "secret": r"[0-9]"}
# The gazetteers.
CALLING_CODES = ("+1", "+33", "+34", "+39", "+41", "+43", "+44", "+49", "+52", "+82")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "eu", "uk", "kr")
FIRST_NAMES = ("anna", "anne", "carlos", "david", "elena", "emma", "hans", "james", "jean", "john", "jose", "juan", "laura", "lucia", "maria", "marie", "martin", "mary", "michael", "paul", "peter", "pierre", "robert", "sophie", "thomas")
PERSONAL_CONTEXT = r"(?i)(?:e-?mail|mail|contact|phone|tel|mobile|call|fax|card|visa|account|konto|cuenta|compte|iban|ssn|passport|address|ip|host|token|secret|password|passwd|key|api|bearer)\W{0,6}$"
OTHER_CONTEXT = r"(?i)(?:version|licen[cs]e|section|chapter|page|isbn|issn|figure|table|v|cc|by|year|no)\W{0,4}$"


def _array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _matches(text: Column, kind: str) -> Column:
    """array<struct<before, left, hit>>: the gap's length and end before each match, and the match."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("before"), F.substring(x, -24, 24).alias("left")))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")), lambda x: F.struct(x["gap"]["before"].alias("before"), x["gap"]["left"].alias("left"), x["hit"].alias("hit")))
    need = _NEEDS[kind]
    worth = F.lit(True) if need is None else (F.instr(text, need) > 0 if kind == "email" else F.rlike(text, F.lit(need)))
    return F.when(worth, found)


def _passes(kind: Column, hit: Column) -> Column:
    """The test of each base kind; all else passes."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    n = F.length(digits)
    return F.when(kind == "ip", small).when(kind == "card", F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)).when(kind == "phone", n.between(10, 15)).otherwise(True)


def candidates(numbered: DataFrame) -> DataFrame:
    """``numbered(rid, m)``, m: the matches of each kind -> (rid, kind, start, end, hit, left).

    Base kinds that fail their test are not among them. Offsets count code points, the end is
    exclusive. All matches of a text fit in a task, since the text does.
    """
    found = numbered.select("rid", "m.*")
    rows = found.select("rid", F.expr("stack(" + str(len(KINDS)) + ", " + ", ".join(f"'{k}', `{k}`" for k in KINDS) + ") as (kind, found)")).filter(F.size("found") > 0)
    one = rows.select("rid", "kind", F.posexplode("found").alias("pos", "m")).select("rid", "kind", "pos", "m.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = one.withColumn("end", F.sum((F.col("before") + F.length("hit")).cast("long")).over(so_far))
    return ends.filter(_passes(F.col("kind"), F.col("hit"))).select("rid", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "left")


def votes(spans: DataFrame) -> DataFrame:
    """Adds v0 ... v5, the labelers' votes: 1 personal, 0 not, null no vote."""
    kind, hit, left = F.col("kind"), F.col("hit"), F.col("left")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    base = kind.isin(*BASE)
    strict = F.when(base, 1).when(hit.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9a-fA-F]{32,})$"), 1).when(kind == "number", F.when(n.between(9, 15), None).otherwise(0))
    gazetteer = (
        F.when((kind == "phone") & F.exists(_array(*CALLING_CODES), lambda c: F.startswith(hit, c)), 1)
        .when((kind == "email") & F.array_contains(_array(*DOMAIN_ENDS), F.lower(F.substring_index(hit, ".", -1))), 1)
        .when((kind == "name") & F.arrays_overlap(_array(*FIRST_NAMES), F.split(F.lower(hit), r"[^\w]+")), 1)
        .when((kind == "secret") & F.lower(hit).rlike("^[a-z]+[0-9]{1,2}$"), 0)
    )
    context = F.when(left.rlike(PERSONAL_CONTEXT), 1)
    other = F.when(left.rlike(OTHER_CONTEXT), 0)
    mixed = F.when(kind == "secret", F.when(hit.rlike("^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9]"), 1).otherwise(0)).when(kind == "name", F.when(hit.rlike(r"\x20\S+\x20"), 1)).when(kind == "number", F.when(n.between(9, 12), 1).otherwise(0))
    dull = F.when((n > 3) & (F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) == 0), 0)
    return spans.withColumns({f"v{i}": v.cast("int") for i, v in enumerate((strict, gazetteer, context, other, mixed, dull))})


LABELERS = 6


def reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 50) -> tuple[float, list[float]]:
    """EM over (votes, count): the prior log-odds, and the log-odds that each labeler's vote is right.

    Silence says nothing, and a labeler is taken to be right more often than not (0.55 to 0.99);
    at first a span's class is the share of yes among its votes.
    """
    post = [(0.5 + v.count(1)) / (1 + v.count(1) + v.count(0)) for v, _ in patterns]
    prior, weights = 0.0, [0.0] * LABELERS
    for _ in range(rounds if patterns else 0):
        yes = sum(p * c for p, (_, c) in zip(post, patterns))
        no = sum((1 - p) * c for p, (_, c) in zip(post, patterns))
        prior = math.log((yes + 1) / (no + 1))
        for j in range(LABELERS):
            right = sum(c * (p if v[j] else 1 - p) for p, (v, c) in zip(post, patterns) if v[j] is not None)
            voted = sum(c for v, c in patterns if v[j] is not None)
            accuracy = min(0.99, max(0.55, (right + 0.7) / (voted + 1)))
            weights[j] = math.log(accuracy / (1 - accuracy))
        total = [prior + sum(w * (2 * x - 1) for w, x in zip(weights, v) if x is not None) for v, _ in patterns]
        post = [1 / (1 + math.exp(-max(-30.0, min(30.0, t)))) for t in total]
    return prior, weights


def _shape(spans: DataFrame) -> dict[str, Column]:
    """The classifier's features, each with few values."""
    hit, left = F.col("hit"), F.col("left")
    share = F.length(F.regexp_replace(hit, "[^0-9]", "")) / F.length(hit)
    return {
        "kind": F.col("kind"),
        "length": F.least(F.length(hit) / 4, F.lit(12)).cast("int").cast("string"),
        "digits": (share * 5).cast("int").cast("string"),
        "upper": hit.rlike("[A-Z]").cast("string"),
        "marks": F.least(F.size(F.array_distinct(F.split(F.regexp_replace(hit, "[A-Za-z0-9]", ""), ""))), F.lit(4)).cast("string"),
        "before": F.when(left.rlike(PERSONAL_CONTEXT), "personal").when(left.rlike(OTHER_CONTEXT), "other").when(left.rlike(r"[\"'=:]\s?$"), "mark").when(left.rlike(r"\s$"), "space").when(F.length(left) == 0, "start").otherwise("text"),
    }


def added(spans: DataFrame, floor: float = 0.0) -> DataFrame:
    """The candidates of the wider kinds that the trained classifier accepts, as (rid, kind, start, end)."""
    voted = checkpointed(votes(spans))
    names = [f"v{i}" for i in range(LABELERS)]
    patterns = [(tuple(r[:LABELERS]), r["count"]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]  # 3^6 rows at most
    prior, weights = reliabilities(patterns)
    total = F.lit(prior)
    for name, w in zip(names, weights):
        total = total + F.when(F.col(name) == 1, w).when(F.col(name) == 0, -w).otherwise(0.0)
    belief = voted.withColumn("belief", 1 / (1 + F.exp(-total)))
    shape = _shape(voted)
    described = belief.withColumns({f"f_{k}": v for k, v in shape.items()})
    soft = described.select("belief", F.explode(F.array(*[F.concat_ws("=", F.lit(k), F.col(f"f_{k}")) for k in shape])).alias("feature")).groupBy("feature").agg(F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no"))
    counts = {r["feature"]: (r["yes"], r["no"]) for r in soft.collect()}  # a few dozen values
    yes, no = (sum(v[i] for k, v in counts.items() if k.startswith("kind=")) for i in (0, 1))
    if not counts:
        return spans.select("rid", "kind", "start", "end").limit(0)
    # one pseudo-count, split as the classes are: a rare value says little about either
    share = yes / (yes + no)
    weight = {k: math.log((a + share) / (b + 1 - share) * (no + 1 - share) / (yes + share)) for k, (a, b) in counts.items()}
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(w)) for k, w in sorted(weight.items())))
    final = F.lit(math.log((yes + 1) / (no + 1)))
    for k in shape:
        final = final + F.coalesce(F.element_at(table, F.concat_ws("=", F.lit(k), F.col(f"f_{k}"))), F.lit(0.0))
    return described.filter(~F.col("kind").isin(*BASE)).filter(final > floor).select("rid", "kind", "start", "end")


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, the four counts, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind. A null text counts as empty: no spans,
    and base_sha256 is that of the empty string. Rows without doc_id and repeated rows stay, each
    with its own spans. Other columns are not read.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = checkpointed(texts.select("rid", "doc_id", F.struct(*[_matches(F.col("text"), k).alias(k) for k in KINDS]).alias("m")))
    spans = checkpointed(candidates(numbered))
    base = spans.filter(F.col("kind").isin(*BASE)).select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    more = added(spans).withColumn("base", F.lit(False))
    by_start = Window.partitionBy("rid").orderBy("start", F.desc("base"), "end")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    lines = base.unionByName(more)
    lines = lines.withColumn("last_end", F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next_start", F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing)))
    apart = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & (F.coalesce("next_start", F.col("end")) >= F.col("end"))
    lines = lines.filter(F.col("base") | apart)
    rank = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(KINDS))), F.col("kind"))
    per_row = lines.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("all"))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>"))
    out = numbered.select("rid", "doc_id").join(per_row, "rid", "left").select("doc_id", every.alias("all"))
    count = lambda k: F.size(F.filter("all", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(F.filter("all", lambda x: x["base"]), named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", named), ",").alias("spans"),
    )
