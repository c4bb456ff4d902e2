"""Text functions, postings and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import extract as X
from folio.functions import text as T
from folio.operators import postings as P
from folio.plans import model as M
from folio.plans.registry import query
from folio.sources.tables import table

W = f"WITH {M.UNITS_SQL}"
PHRASE = "within thirty days"


def _bm25(terms: list[str], need: int) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{W}, h AS (SELECT unit_id, document_id, len(words) AS dl, t AS term, count(*) AS tf FROM (SELECT unit_id, document_id, words, unnest(words) AS t FROM w) WHERE t IN ({listed}) GROUP BY ALL),
      f AS (SELECT term, count(*) AS df FROM h GROUP BY term), n AS (SELECT count(*) AS n FROM w),
      s AS (SELECT unit_id, document_id, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 120.0))), 6) AS score
            FROM h JOIN f USING (term) CROSS JOIN n GROUP BY unit_id, document_id HAVING count(*) >= {need})"""


@query(
    _bm25(PHRASE.split(), 3)
    + f", p AS (SELECT unit_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' {PHRASE} ')) SELECT unit_id, document_id, score FROM s WHERE unit_id IN (SELECT unit_id FROM p) ORDER BY score DESC, unit_id LIMIT 10"
)
def phrase_bm25_top10(s, d):
    index = M.index(s, d)
    found = index.ranked(PHRASE.split()).join(index.phrase(PHRASE).select("unit_id"), "unit_id", "left_semi")
    return found.select("unit_id", "document_id", "score").orderBy(F.desc("score"), "unit_id").limit(10)


@query(_bm25(["supplier", "invoice", "quarter"], 3) + " SELECT unit_id, document_id, score FROM s")
def all_terms(s, d):
    return M.index(s, d).ranked(["supplier", "invoice", "quarter"]).drop("matched")


@query(_bm25(["supplier", "invoice", "quarter", "landlord"], 3) + " SELECT unit_id, document_id, matched, score FROM s WHERE matched < 4")
def most_terms(s, d):
    return M.index(s, d).ranked(["supplier", "invoice", "quarter", "landlord"], need=3).where("matched < 4")


@query(f"{W} SELECT DISTINCT unit_id FROM (SELECT unit_id, unnest(words) AS t FROM w) WHERE t IN ('warranty', 'landlord')")
def any_term(s, d):
    return M.index(s, d).postings("w", ["warranty", "landlord"]).select("unit_id").distinct()


@query(f"{W} SELECT t AS term, count(DISTINCT unit_id) AS df FROM (SELECT unit_id, unnest(words) AS t FROM w) GROUP BY t")
def term_df(s, d):
    return M.index(s, d).terms("w")


@query(f"{W} SELECT unit_id, t AS term, count(*) AS tf FROM (SELECT unit_id, unnest(words) AS t FROM w) GROUP BY ALL")
def term_tf(s, d):
    return M.index(s, d).postings("w").select("unit_id", "term", "tf")


@query(
    f"{W}, x AS (SELECT unit_id, 'w' AS kind, unnest(words) AS term FROM w UNION ALL SELECT unit_id, 'r', reverse(t) FROM (SELECT unit_id, unnest(words) AS t FROM w) WHERE length(t) >= 3 AND regexp_matches(t, '[0-9]'))"
    " SELECT kind, count(*) AS postings, count(DISTINCT term) AS terms FROM (SELECT DISTINCT unit_id, kind, term FROM x) GROUP BY kind"
)
def posting_totals(s, d):
    return P.postings(M.units(s, d), "wr").groupBy("kind").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


@query(f"{W} SELECT unit_id, len(words) AS n_terms FROM w")
def n_terms(s, d):
    return M.units(s, d).select("unit_id", F.size(T.tokens(F.col("text"))).alias("n_terms"))


@query(f"{W} SELECT DISTINCT t AS term, length(t) AS length FROM (SELECT unnest(words) AS t FROM w) WHERE regexp_full_match(t, '[a-z]{{4,32}}')")
def vocabulary(s, d):
    return P.vocabulary(M.index(s, d).terms("w"))


@query(f"{W} SELECT t AS term, count(*) AS n FROM (SELECT unnest(words) AS t FROM w) WHERE starts_with(t, 'ware') GROUP BY t")
def prefix_terms(s, d):
    return M.index(s, d).starting("ware").groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"{W} SELECT DISTINCT t AS term FROM (SELECT unnest(words) AS t FROM w) WHERE ends_with(t, '84') AND length(t) >= 3 AND regexp_matches(t, '[0-9]')")
def suffix_terms(s, d):
    return M.index(s, d).starting("48", "r").select(F.reverse("term").alias("term")).distinct()


@query(f"{W} SELECT unit_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' follow up workshop ') OR contains(' ' || array_to_string(words, ' ') || ' ', ' followup workshop ') OR contains(' ' || array_to_string(words, ' ') || ' ', ' follow upworkshop ')")
def joined_form(s, d):
    index, found = M.index(s, d), None
    for form in ["follow up workshop", *T.join_variants(["follow", "up", "workshop"])]:
        if " " in form:
            some = index.phrase(form).select("unit_id")
            found = some if found is None else found.unionByName(some)
    return found.distinct()


@query(
    f"{W}, x AS (SELECT unit_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[-/#_.][\\p{{L}}\\p{{N}}]+)*')) AS t FROM w), k AS (SELECT unit_id, regexp_replace(lower(t), '[^0-9a-z]', '', 'g') AS ident FROM x"
    " WHERE (regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]')) OR regexp_matches(t, '^[0-9]+(?:[-/#_][0-9]+)+$') OR regexp_matches(t, '^[0-9]{5,}$'))"
    " SELECT DISTINCT unit_id, ident FROM k WHERE length(ident) >= 3 AND regexp_matches(ident, '[0-9]')"
)
def identifiers(s, d):
    return M.units(s, d).select("unit_id", F.explode(T.identifiers(F.col("text"))).alias("ident"))


@query(f"{W} SELECT unit_id, document_id FROM w WHERE list_contains(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[-/#_.][\\p{{L}}\\p{{N}}]+)*'), lambda t: regexp_replace(lower(t), '[^0-9a-z]', '', 'g')), 'qt2022981653')")
def exact_identifier(s, d):
    return M.index(s, d).identifier("qt2022981653")


@query(
    "WITH t AS (SELECT document_id, 'Write to ' || regexp_replace(lower(filename), '[^a-z0-9_.]', '', 'g') || '@' || tenant_id || '.example, or again to a@b.example.' AS text FROM documents)"
    " SELECT DISTINCT document_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS email FROM t"
)
def contacts(s, d):
    """Addresses made of the table's columns, as the texts hold none; the extraction operator finds them."""
    text = F.concat(F.lit("Write to "), F.regexp_replace(F.lower("filename"), "[^a-z0-9_.]", ""), F.lit("@"), "tenant_id", F.lit(".example, or again to a@b.example."))
    found = X.analyze(M.documents(s, d).select("document_id", F.lit(1).alias("page"), text.alias("text")), ("contact",))
    return found.where("name = 'email'").select("document_id", F.col("value").alias("email")).distinct()


@query("SELECT DISTINCT value, list_sort(list_distinct(list_transform(regexp_extract_all(value, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), lambda x: lower(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g'))))) AS variants FROM entities")
def camel_variants(s, d):
    return table(s, d, "entities").select("value").distinct().select("value", T.camel_variants(F.col("value")).alias("variants"))


@query(f"""WITH {M.fold_sql(f"SELECT DISTINCT unnest({M.words_sql('text')}) AS word FROM pages WHERE kind = 'ocr'")} SELECT word, folded FROM folds""")
def fold_tokens(s, d):
    words = table(s, d, "pages").where("kind = 'ocr'").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.fold(F.array("word"))[0].alias("folded"))


@query("SELECT DISTINCT document_id, trim(regexp_replace(lower(translate(title, '‘’‚‛′“”„‟″‐‑‒–—―−', '''''''''''\"\"\"\"\"-------')), '\\s+', ' ', 'g')) AS title FROM documents WHERE title IS NOT NULL")
def normalized_titles(s, d):
    return M.documents(s, d).where("title IS NOT NULL").select("document_id", T.normalize(F.col("title")).alias("title")).distinct()


@query(f"SELECT document_id FROM documents WHERE list_has_all({M.words_sql('filename')}, ['lease', 'agreement'])")
def filename_terms(s, d):
    words = T.tokens(F.regexp_replace("filename", "_", " "))
    return M.documents(s, d).where(F.size(F.array_intersect(words, F.array(F.lit("lease"), F.lit("agreement")))) == 2).select("document_id")


@query(
    f"{W} SELECT unit_id, pos, cell, try_cast(nullif(replace(regexp_extract(cell, '^[^0-9-]{{0,4}}(-?[0-9][0-9,]*(?:\\.[0-9]+)?) ?%?$', 1), ',', ''), '') AS DOUBLE) AS number"
    " FROM (SELECT unit_id, unnest(range(len(c))) AS pos, trim(unnest(c)) AS cell FROM (SELECT unit_id, string_split(text, '|') AS c FROM u WHERE unit_type = 'table_row')) x"
)
def cell_numbers(s, d):
    rows = M.units(s, d).where("unit_type = 'table_row'").select("unit_id", F.posexplode(F.split("text", r"\|")).alias("pos", "cell"))
    rows = rows.withColumn("cell", F.trim("cell"))
    return rows.withColumn("number", T.cell_number(F.col("cell")))


@query("SELECT document_id, page, line FROM (SELECT DISTINCT document_id, page, unnest(string_split(text, chr(10))) AS line FROM pages) WHERE length(line) <= 90 AND length(trim(line)) > 0 AND NOT regexp_matches(line, '[.,;]\\s*$') AND upper(line) = line AND length(regexp_replace(line, '[^\\p{L}]', '', 'g')) >= 4 AND NOT contains(line, 'ß')")
def heading_lines(s, d):
    lines = table(s, d, "pages").select("document_id", "page", F.explode(F.split("text", "\n")).alias("line")).distinct()
    capitals = T.heading_like(F.col("line")) & (F.upper("line") == F.col("line")) & (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= 4)
    return lines.where(capitals & ~F.col("line").contains("ß"))


@query(f"{W} SELECT unit_id, greatest(0, p - 1 - 120) AS raw FROM (SELECT unit_id, strpos(lower(text), 'thirty days') AS p FROM w) WHERE p > 0")
def evidence_offsets(s, d):
    u = M.units(s, d).withColumn("p", F.instr(F.lower("text"), "thirty days")).where("p > 0")
    return u.select("unit_id", F.greatest(F.lit(0), F.col("p") - 1 - 120).alias("raw"))


@query(
    f"{W}, a AS (SELECT unit_id, text, greatest(0, p - 121) AS raw FROM (SELECT unit_id, text, strpos(lower(text), 'thirty days') AS p FROM w) WHERE p > 0),"
    " b AS (SELECT unit_id, text, CASE WHEN raw = 0 THEN 0 ELSE raw + strpos(substring(text, raw + 1, 360), ' ') END AS start FROM a) SELECT unit_id, start, substring(text, start + 1, 360) AS window FROM b"
)
def evidence_windows(s, d):
    u = M.units(s, d).withColumn("p", F.instr(F.lower("text"), "thirty days")).where("p > 0")
    start, text = T.window_around(F.col("text"), F.col("p"))
    return u.select("unit_id", start.alias("start"), text.alias("window"))


@query(
    f"{W}, t AS (SELECT DISTINCT t AS term FROM (SELECT unnest(words) AS t FROM w) WHERE regexp_full_match(t, 'w[a-z]{{3,31}}') AND abs(length(t) - 9) <= 2),"
    " g AS (SELECT term, list_distinct(list_transform(range(1, length(term) + 2), lambda i: ('  ' || term || ' ')[i:i + 2])) AS g, list_distinct(list_transform(range(1, 11), lambda i: '  warehuose '[i:i + 2])) AS h FROM t)"
    " SELECT term, CAST(damerau_levenshtein(term, 'warehuose') AS INT) AS distance FROM g WHERE damerau_levenshtein(term, 'warehuose') <= 2 AND len(list_intersect(g, h)) >= 0.3 * len(list_distinct(list_concat(g, h)))"
    " QUALIFY rank() OVER (ORDER BY damerau_levenshtein(term, 'warehuose')) = 1 ORDER BY term LIMIT 5"
)
def typo_candidates(s, d):
    return P.corrections(P.vocabulary(M.index(s, d).terms("w")), "warehuose")


@query()
def folded_text(s, d):
    return M.documents(s, d).select("document_id", T.normalize_udf("title").alias("title"))
