"""Text rules over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import doubled_glyphs, doubled_repaired, normal_answer, re2, trimmed
from tallyloom.plans.define import query
from tallyloom.sources.bind import Tables

#: Each rule is one regular expression, which re2() makes Java read as RE2 does.
#: A text that tells which choice is right.
LEAK = r"(?i)\bsolutions?:|\bkey to the (questions|exercises)\b|\bthe (right|correct) (choice|one) (is|was) [a-d]\b|\brespuesta correcta\b"
#: A path of the writer's own machine: an absolute path of two folders or more, a drive or a file address; not the path of a web address.
PATH = r'(?:^|[\s"(=])(?:~?/[\w.-]+/[\w.-]+/[\w./-]*|[A-Z]:[\\/][\w.-]+|file:/{2,3}\w)'
LICENSE = r"(?i)\blicen[sc]e(d)?\b|\ball rights reserved\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?i)\b(token|password|api[_-]?key)\s*[=:]\s*\S+"
CONNECTIVE = r"(?i)\b(because|therefore|so|since|thus|parce que|porque|weil|denn|donc)\b"
FLAGS = {"leak": LEAK, "path": PATH, "license": LICENSE, "email": EMAIL, "secret": SECRET}


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@query("text_quality", rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
m AS (SELECT doc_id, length(coalesce(text, ''))::INT AS chars, len(w)::INT AS words, len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: length(x) >= 3)))::INT AS distinct_words,
             length(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]', '', 'g'))::INT AS alnum, regexp_matches(coalesce(text, ''), '{CONNECTIVE}') AS reasoned FROM d)
SELECT doc_id, chars, words, distinct_words, alnum, concat_ws(',', CASE WHEN chars NOT BETWEEN 400 AND 20000 THEN 'length' END, CASE WHEN words < 80 THEN 'words' END, CASE WHEN distinct_words < 6 THEN 'repetitive' END,
       CASE WHEN alnum < 40 THEN 'not_substantive' END, CASE WHEN NOT reasoned THEN 'no_connective' END) AS violations FROM m""")
def text_quality(t: Tables) -> DataFrame:
    """Length, words, distinct words, letters and digits, and the rules a text breaks."""
    text = F.coalesce("text", F.lit(""))
    d = t.read("documents").select("doc_id", text.alias("text"), word_list(text).alias("w"))
    m = d.select(
        "doc_id", F.length("text").alias("chars"), F.size("w").alias("words"), F.size(F.array_distinct(F.filter(F.transform("w", F.lower), lambda x: F.length(x) >= 3))).alias("distinct_words"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).alias("alnum"), F.col("text").rlike(re2(CONNECTIVE)).alias("reasoned"))
    broken = F.concat_ws(",", F.when(~F.col("chars").between(400, 20000), "length"), F.when(F.col("words") < 80, "words"), F.when(F.col("distinct_words") < 6, "repetitive"),
                         F.when(F.col("alnum") < 40, "not_substantive"), F.when(~F.col("reasoned"), "no_connective"))
    return m.select("doc_id", "chars", "words", "distinct_words", "alnum", broken.alias("violations"))


@query("leak_and_path_flags", "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {n}" for n, p in FLAGS.items()) + " FROM documents")
def leak_and_path_flags(t: Tables) -> DataFrame:
    """Which unwanted patterns each document contains."""
    text = F.coalesce("text", F.lit(""))
    return t.read("documents").select("doc_id", *(text.rlike(re2(p)).alias(n) for n, p in FLAGS.items()))


@query("cleaned_lines", r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))),
     lambda x: NOT regexp_matches(x, '^[0-9 ]+$') AND NOT regexp_matches(x, '(?i)licen[sc]e')) AS kept FROM documents)
SELECT doc_id, len(kept)::INT AS kept, sha256(trim(regexp_replace(array_to_string(kept, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS hash FROM d""")
def cleaned_lines(t: Tables) -> DataFrame:
    """Lines trimmed, page numbers and license lines taken out, runs of blank lines made one, the rest joined."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: trimmed(F.regexp_replace(x, "[ \t]+", " ")))
    kept = F.filter(lines, lambda x: ~x.rlike(re2("^[0-9 ]+$")) & ~x.rlike(re2("(?i)licen[sc]e")))
    d = t.read("documents").select("doc_id", kept.alias("kept"))
    return d.select("doc_id", F.size("kept").alias("kept"), F.sha2(F.trim(F.regexp_replace(F.array_join("kept", "\n"), r"\n{3,}", "\n\n"), F.lit("\n")), 256).alias("hash"))


@query("balanced_marks", """
SELECT conv_id, turn, length(text) - length(replace(text, '"', '')) AS quotes, (length(text) - length(replace(text, '"', ''))) % 2 = 0 AS balanced, length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', '')) AS brackets
FROM conversations WHERE text IS NOT NULL""")
def balanced_marks(t: Tables) -> DataFrame:
    """Quote and bracket balance of every turn."""
    n = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    return t.read("conversations").where("text is not null").select("conv_id", "turn", n('"').cast("bigint").alias("quotes"), (n('"') % 2 == 0).alias("balanced"), (n("(") == n(")")).alias("brackets"))


SHINGLE = 5


@query("benchmark_recall", rf"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM b),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM d),
c AS (SELECT DISTINCT item_id, doc_id FROM bs JOIN ds USING (s)),
bt AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
dt AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL)
SELECT c.item_id AS item_id, c.doc_id AS doc_id, round(sum(least(bt.n, coalesce(dt.n, 0))) / sum(bt.n), 6)::DOUBLE AS recall
FROM c JOIN bt ON bt.item_id = c.item_id LEFT JOIN dt ON dt.doc_id = c.doc_id AND dt.t = bt.t GROUP BY ALL""")
def benchmark_recall(t: Tables) -> DataFrame:
    """For documents that share five words in a row with an item: how much of the item's words they have.

    Runs of words are hashed where the documents lie. The items' hashes are broadcast where
    they are counted to be few, so that no run of a document is shuffled; else both sides are.
    """
    w = word_list(F.lower("text")).alias("w")
    b = t.read("benchmark").where("text is not null").select("item_id", w)
    d = t.read("documents").where("text is not null").select("doc_id", w)
    bs = b.select("item_id", F.explode(F.array_distinct(word_runs(F.col("w")))).alias("s"))
    small = bs.count() <= MOST_HASHES  # at most 16 bytes each
    runs = d.select("doc_id", F.explode(word_runs(F.col("w"))).alias("s"))
    c = runs.join(F.broadcast(bs) if small else bs, "s").select("item_id", "doc_id").distinct()
    bt = b.select("item_id", F.explode("w").alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    found = t.read("documents").select("doc_id", "text").join(c.select("doc_id").distinct(), "doc_id", "left_semi")
    dt = found.select("doc_id", F.explode(word_list(F.lower("text"))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("m"))
    rows = c.join(bt, "item_id").join(dt, ["doc_id", "t"], "left")
    share = F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")
    return rows.groupBy("item_id", "doc_id").agg(F.round(share, 6).alias("recall"))


MOST_HASHES = 1_000_000


def word_runs(w: Column) -> Column:
    """One hash for each five words in a row."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, some).otherwise(F.array().cast("array<bigint>"))


@query("near_token", r"""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark)
SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND levenshtein(a.w, b.w) = 1""")
def near_token(t: Tables) -> DataFrame:
    """Pairs of words one edit apart, met through what is left after deleting a letter."""
    w = t.read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.expr("left(w, 0)"), F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))
    keys = w.select("w", F.explode(F.array_distinct(F.concat(F.array("w"), cut))).alias("key"))
    pairs = keys.select(F.col("w").alias("a"), "key").join(keys.select(F.col("w").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") == 1)


@query("page_links", r"""
WITH l AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, len(h)::INT AS links, len(list_distinct(h))::INT AS distinct_links, h[1] AS first_link, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_matches(url, '^https?://[^/ ]+(/.*)?$') AS valid FROM l""")
def page_links(t: Tables) -> DataFrame:
    """Links of each page, and whether its address is well formed."""
    h = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))
    p = t.read("pages").select("page_id", "url", h.alias("h"))
    return p.select("page_id", F.size("h").alias("links"), F.size(F.array_distinct("h")).alias("distinct_links"), F.try_element_at("h", F.lit(1)).alias("first_link"),
                    F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.col("url").rlike("^https?://[^/ ]+(/.*)?$").alias("valid"))


@query("page_section", r"""
SELECT page_id, regexp_extract(coalesce(html, ''), '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(coalesce(html, ''), '<h1>')) = 1 AS single,
       least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT *, coalesce(try_cast(regexp_extract(url, '([0-9]+)', 1) AS BIGINT), 0) AS a, length(html) AS b FROM pages)""")
def page_section(t: Tables) -> DataFrame:
    """What stands between two headings, exactly once; a range put in order."""
    html = F.coalesce("html", F.lit(""))
    a, b = F.coalesce(F.expr("try_cast(regexp_extract(url, '([0-9]+)', 1) as bigint)"), F.lit(0)), F.length("html").cast("bigint")
    return t.read("pages").select("page_id", F.regexp_extract(html, "<h1>([^<]*)</h1>", 1).alias("title"), (F.regexp_count(html, F.lit("<h1>")) == 1).alias("single"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


@query("doubled_tokens")
def doubled_tokens(t: Tables) -> DataFrame:
    """How many tokens have letters in pairs, and the digest of the text with doubled tokens repaired."""
    text = F.coalesce("text", F.lit(""))
    return t.read("documents").select("doc_id", doubled_glyphs(text).alias("doubled"), F.sha2(doubled_repaired(text), 256).alias("repaired"))


@query("normal_answers")
def normal_answers(t: Tables) -> DataFrame:
    """Every line of each document as a normalised answer (NFKC)."""
    lines = t.read("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", normal_answer("text").alias("answer"))
