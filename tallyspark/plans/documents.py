"""Texts as lines: labels, blocks, keywords, and turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction, rules
from ..sources.scans import inline, table

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


LINES = """l AS (SELECT doc_id, i - 1 AS line_no, trim(s[i]) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)), k AS (SELECT * FROM l WHERE line <> '')"""
#: The marks that don't count when rules are compared, as the oracle writes them.
MARKS = r"""[\s\x0B\x1C-\x1F\x{0085}\p{Z}"''‘’“”_\-.,()\[\]{}:/\\|*×]+"""
# Rules for the query below.
RULES = [("EN", "CONTAINS", "the ", 10), ("EN", "CONTAINS", "ing ", 20), ("FR", "CONTAINS", "une ", 10), ("FR", "CONTAINS", "eau", 30), ("DE", "CONTAINS", "und ", 10), ("ES", "CONTAINS", "ción", 10)]


@query(f"WITH {LINES} SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, max(line_no) AS last FROM k GROUP BY 1")
def text_lines(spark, d):
    return extraction.lines(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").cast("long").alias("last"))


@query(f"WITH {LINES}, f AS (SELECT doc_id, line, min(line_no) AS n FROM k GROUP BY 1, 2), o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM f GROUP BY 1) SELECT d.doc_id, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id")
def dedupe_lines(spark, d):
    return extraction.distinct_lines(table(spark, d, "documents"), "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {LINES}, v AS (SELECT *, CASE WHEN length(line) > 200 THEN length(line) END AS v FROM k), w AS (SELECT doc_id, line_no, v, lead(v, 1) OVER o AS v1, lead(v, 2) OVER o AS v2, lead(v, 3) OVER o AS v3, contains(line, '@') AS q FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
  SELECT doc_id, line_no, coalesce(v, v1, v2, v3) AS value FROM w WHERE q""")
def lookahead(spark, d):
    rows = extraction.lines(table(spark, d, "documents"), "doc_id")
    out = extraction.near_label(rows, "doc_id", F.contains("line", F.lit("@")), F.when(F.length("line") > 200, F.length("line")))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("value").cast("long").alias("value"))


@query(f"WITH {LINES}, b AS (SELECT doc_id, CAST(sum(CASE WHEN contains(line, '@') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block, line FROM k) SELECT doc_id, block, count(*) AS n FROM b GROUP BY 1, 2")
def line_blocks(spark, d):
    rows = extraction.lines(table(spark, d, "documents"), "doc_id")
    return extraction.blocks(rows, "doc_id", F.contains("line", F.lit("@"))).groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, s AS (SELECT *, min(CASE WHEN contains(line, 'a') THEN line_no END) OVER (PARTITION BY doc_id) AS b FROM k), t AS (SELECT *, min(CASE WHEN contains(line, '@') THEN line_no END) OVER (PARTITION BY doc_id) AS e FROM s WHERE line_no > b) SELECT doc_id, count(*) AS n FROM t WHERE e IS NULL OR line_no < e GROUP BY 1""")
def section_slice(spark, d):
    rows = extraction.lines(table(spark, d, "documents"), "doc_id")
    return extraction.section(rows, "doc_id", F.contains("line", F.lit("a")), F.contains("line", F.lit("@"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_VALUES = ", ".join(f"('{c}', '{k}', {p})" for c, _, k, p in RULES)
SCORED = f"""r(code, keyword, priority) AS (VALUES {_VALUES}), z AS (SELECT code, lower(keyword) AS w, regexp_replace(lower(trim(keyword)), '{MARKS}', '', 'g') AS kk, priority FROM r),
  t AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(trim(coalesce(text, ''))), '{MARKS}', '', 'g') AS c FROM documents),
  h AS (SELECT doc_id, code, 45 + least(40, 6 * length(kk)) + greatest(0, 25 - 0.15 * priority) AS points FROM t JOIN z ON contains(c, kk) OR contains(low, w)), s AS (SELECT doc_id, code, CAST(sum(points) AS DOUBLE) AS score, count(*) AS hits FROM h GROUP BY 1, 2)"""


def _scored(spark, d):
    r = inline(spark, RULES, "code string, match_type string, keyword string, priority int").withColumns({"active_yn": F.lit("Y"), "status": F.lit("APPROVED")})
    return rules.scored(table(spark, d, "documents"), "doc_id", "text", rules.usable(r))


@query(f"WITH {SCORED} SELECT doc_id, code, score, hits FROM s")
def keyword_score(spark, d):
    return _scored(spark, d)


@query(f"WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS nx FROM s) SELECT doc_id, code, score FROM n WHERE r = 1 AND score >= 55 AND score - coalesce(nx, 0) >= 20")
def classify_gap(spark, d):
    return rules.clear_winner(_scored(spark, d), "doc_id")


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents")
def char_shares(spark, d):
    s = text.char_shares(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s["latin"].cast("long").alias("latin"), s["digits"].cast("long").alias("digits"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '||' ORDER BY turn) AS roles, arg_min(text, turn) AS opening FROM conversations GROUP BY 1")
def conversation_turns(spark, d):
    from ..operators.facts import joined_text

    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), joined_text(F.col("role"), ["turn"]).alias("roles"), F.min_by("text", "turn").alias("opening"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def labelled_flag(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")  # noqa: E741
    return table(spark, d, "documents").join(l, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("id").isNotNull().cast("int").alias("labelled"))


# Rules for the query below.
TYPES = [("the ", "CONTAINS", "LETTER", 10, 1), ("ing ", "CONTAINS", "LETTER", None, 2), ("une ", "FUZZY", "FACTURE", 0, 3), ("eau", "CONTAINS", "FACTURE", 15, 4), ("und ", "CONTAINS", "BRIEF", 25, 5), ("ción", "CONTAINS", "carta", 19, 6), ("", "CONTAINS", "NONE", 99, 7)]


@query(f"""WITH r(keyword, code, points, place) AS (VALUES ('the ', 'LETTER', 10, 1), ('ing ', 'LETTER', 10, 2), ('une ', 'FACTURE', 10, 3), ('eau', 'FACTURE', 15, 4), ('und ', 'BRIEF', 25, 5), ('ción', 'CARTA', 19, 6)),
  t AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(trim(coalesce(text, ''))), '{MARKS}', '', 'g') AS c FROM documents), s AS (SELECT doc_id, code, sum(points) AS points, min(place) AS place FROM t JOIN r ON contains(c, trim(keyword)) OR contains(low, keyword) GROUP BY 1, 2),
  b AS (SELECT doc_id, code, points, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, place) AS k FROM s)
  SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'INVOICE' WHEN d.doc_id % 10 = 1 AND contains(text, '@') THEN 'HANDWRITTEN_FORM_RECEIPT' WHEN d.doc_id % 10 = 2 THEN 'TRANSPORT_RECEIPT' WHEN points >= 20 THEN code ELSE 'RECEIPT' END AS document_type FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1""")
def document_types(spark, d):
    """Every text's type: asked for, seen, or by rules."""
    r = inline(spark, TYPES, "keyword string, match_type string, code string, score int, place int")
    k = F.col("doc_id") % 10
    asked = F.when(k == 0, " invoice ").when(k == 3, "receipt").when(k == 4, "")
    return rules.document_types(table(spark, d, "documents"), "doc_id", "text", asked, r, (k == 1) & F.contains("text", F.lit("@")), k == 2)


# A rule of each kind for the query below, the text that it fits, and its score.
KINDS = [("A", "EXACT", "1+1", "1 + 1", 141.5), ("B", "CONTAINS", "R&D", "the R&D unit", 86.5), ("C", "REGEX", "[i", "tax[i", 99.5), ("D", "REGEX", r"taxi\s+[0-9]+", "TAXI 77", 133.5), ("E", "exact", "a×b", "AB", 135.5), ("F", "FUZZY", "c++", "C++ 17", 86.5), ("G", "else", "ghi", "G-H-I", 86.5)]


@query("WITH r(k, code, score) AS (VALUES " + ", ".join(f"({i}, '{c}', {s}::DOUBLE)" for i, (c, _, _, _, s) in enumerate(KINDS)) + ") SELECT p_partkey, code, score, CAST(1 AS BIGINT) AS hits FROM part JOIN r ON k = p_partkey % 9")
def rule_kinds(spark, d):
    """Texts that one rule each fits by its kind, and texts that none fits."""
    k = F.col("p_partkey") % 9
    text = F.coalesce(*[F.when(k == i, F.lit(t)) for i, (_, _, _, t, _) in enumerate(KINDS)], F.when(k == 7, "11 and RD"))
    r = inline(spark, [(c, kind, w, 10, "Y", "APPROVED") for c, kind, w, _, _ in KINDS], "code string, match_type string, keyword string, priority int, active_yn string, status string")
    return rules.scored(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", rules.usable(r))


# Corrections for the query below.
CORRECTIONS = [
    (1, "OCR_TEXT", "ring", "loop", "CONTAINS", 20, "APPROVED", "Y"), (2, "OCR_TEXT", "loop", "hoop", "CONTAINS", 30, "APPROVED", "Y"), (3, "OCR_TEXT", "RED", "crimson", "FUZZY", 10, "APPROVED", "Y"),
    (4, "OCR_TEXT", "b(lue|olt)", r"B\1", "REGEX", 40, "APPROVED", "Y"), (5, "OCR_TEXT", "gear", "wheel", "CONTAINS", 1, "PENDING", "Y"), (6, "ITEM", "Crimson hoop", "ring set", "EXACT", 90, "APPROVED", "Y"), (7, "OCR_TEXT", "(", "x", "REGEX", 1, "APPROVED", "Y"),
]


@query(r"""WITH t AS (SELECT p_partkey, regexp_replace(replace(replace(replace(p_name, 'red', 'crimson'), 'ring', 'loop'), 'loop', 'hoop'), 'b(lue|olt)', 'B\1', 'g') AS text FROM part)
  SELECT p_partkey, text, regexp_replace(CASE WHEN text = 'crimson hoop' THEN 'ring set' ELSE text END, '\s+[A-Za-z0-9]{1,3}$', '') AS value FROM t""")
def corrected_names(spark, d):
    """Names corrected one rule after the other, as texts and as values."""
    r = inline(spark, CORRECTIONS, "id int, dictionary_type string, wrong_text string, corrected_text string, match_type string, priority int, status string, active_yn string")
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_name").alias("value"))
    return rules.corrected(rules.corrected(p, "text", r, ("OCR_TEXT",)), "value", r, ("ITEM", "OCR_TEXT"), whole=True)


@query(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS nx FROM s), w AS (SELECT doc_id, code FROM n WHERE r = 1 AND score >= 55 AND score - coalesce(nx, 0) >= 20)
  SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 7 THEN 'TRANSPORT' WHEN code IS NOT NULL THEN code WHEN contains(lower(coalesce(text, '')), 'zimmer') OR contains(lower(coalesce(text, '')), 'hotel') THEN 'LODGING' WHEN contains(lower(coalesce(text, '')), 'quality') THEN 'SUPPLIES' WHEN d.doc_id % 10 IN (8, 9) THEN 'MEAL' ELSE 'ETC' END AS category FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id""")
def expense_categories(spark, d):
    """Every text's category: transport, rules, hints, meals, or none of them."""
    r = inline(spark, RULES, "code string, match_type string, keyword string, priority int").withColumns({"active_yn": F.lit("Y"), "status": F.lit("APPROVED")})
    k = F.col("doc_id") % 10
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(k == 8, " 김치 카페").when(k == 9, " 우동 소주").otherwise("")).alias("text"))
    return rules.categories(docs, "doc_id", "text", rules.usable(r), [("LODGING", ["zimmer", "Hotel"]), ("SUPPLIES", ["quality"])], k == 7).select("doc_id", "category")


PART_RULES = "SELECT p_partkey AS id, upper(p_brand) AS t, CASE WHEN p_size % 10 = 0 THEN 100 ELSE p_size END AS p FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 5 > 0"


@query(f"SELECT t AS type, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY p, id) AS ids FROM ({PART_RULES}) GROUP BY 1")
def rule_index(spark, d):
    """A rule table's active rules for one document type, by their kind and in the order in which they are tried."""
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(k.alias("id"), F.lower("p_brand").alias("dictionary_type"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).alias("priority"), F.when(k % 4 == 0, "RECEIPT").when(k % 4 == 1, "ALL").when(k % 4 == 2, "INVOICE").otherwise("SLIP").alias("document_type"), F.when(k % 5 == 0, "n").alias("active_yn"), F.when(k % 3 == 0, "approved").otherwise("").alias("status"))
    out = rules.by_type(rules.active(rules.context(r, " invoice")))
    return out.select("type", F.size("rules").cast("long").alias("n"), F.array_join(F.transform("rules", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("""WITH v AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS key, p_brand FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 7 > 0) SELECT key, arg_max(p_brand, p_partkey) AS vendor FROM v GROUP BY 1""")
def vendor_map(spark, d):
    """Vendors by the keys of their wrong spellings; the last correction of a key counts."""
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(k.alias("id"), F.when(k % 3 == 0, "ITEM").when(k % 3 == 1, "vendor").otherwise("OCR_TEXT").alias("dictionary_type"), F.concat(F.lit("(주) "), F.upper("p_name"), F.lit(".")).alias("wrong_text"), F.concat(F.lit(" "), "p_brand").alias("corrected_text"), F.when(k % 7 == 0, "PENDING").alias("status"), F.lit(None).cast("string").alias("active_yn"))
    return rules.vendor_corrections(r)
