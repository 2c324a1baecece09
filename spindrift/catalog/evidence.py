"""Passages, parsers, evidence checks and answers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.adapters import PAPERS_SQL, TURNS_SQL, papers, questions, table, turns
from spindrift.catalog.base import query
from spindrift.catalog.relations import sections
from spindrift.catalog.retrieval import JUDGED, QT, RERANKED, bm25_sql, fused, judged, metrics_sql, overlap_sql, rank_sql, reranked, tokens_sql
from spindrift.functions import text as fx
from spindrift.functions.embedding import hash_embed
from spindrift.operators import chunking
from spindrift.operators.evaluation import chunking_scores, gate, strategies_of_note
from spindrift.operators.store import Store
from spindrift.plans.answers import ambiguity, answer_questions, refusals, shared, sufficient
from spindrift.session import scratch_path, stored
from spindrift.sources import parsers

SECTIONS_SQL = f"""{PAPERS_SQL}, lines AS (SELECT paper_id, unnest(list_zip(l, range(len(l)))) AS z FROM (SELECT paper_id, string_split(text, chr(10)) AS l FROM papers)),
secs AS (SELECT paper_id, CAST(z[2] AS BIGINT) AS section_no, z[1] AS text FROM lines),
based AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY paper_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM secs)"""


def line_sections(spark, sf_dir) -> DataFrame:
    """Every line of a document as a section."""
    return papers(spark, sf_dir).select("paper_id", F.posexplode(F.split("text", "\n")).alias("section_no", "text")).select("paper_id", F.col("section_no").cast("long").alias("section_no"), F.lit(None).cast("string").alias("heading"), "text")


def windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""cut AS (SELECT paper_id, section_no, text AS whole, base, i * {step} AS rel, substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS part FROM (
  SELECT *, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i FROM based))"""


CUT = "SELECT paper_id, section_no, base + rel AS char_start, base + rel + length(part) AS char_end, sha256(concat(paper_id, part)) AS chunk_id FROM cut"
OUT = ["paper_id", "section_no", "char_start", "char_end", "chunk_id"]


@query(f"WITH {SECTIONS_SQL}, {windows_sql(1600, 200)} {CUT}")
def chunk_fixed_overlap(spark, sf_dir):
    return chunking.fixed_windows(line_sections(spark, sf_dir)).select(*OUT)


@query(f"WITH {SECTIONS_SQL}, {windows_sql(400, 0)} {CUT}")
def chunk_fixed_no_overlap(spark, sf_dir):
    return chunking.fixed_windows(line_sections(spark, sf_dir), 400, 0).select(*OUT)


@query(f"WITH {SECTIONS_SQL}, {windows_sql(300, 50)} {CUT} WHERE length(whole) > 300 OR regexp_matches(whole, '\\S')")
def chunk_structure_aware(spark, sf_dir):
    return chunking.structure_aware(line_sections(spark, sf_dir), 300, 50).select(*OUT)


@query(f"WITH {SECTIONS_SQL} SELECT paper_id, section_no, base FROM based")
def chunk_section_offsets(spark, sf_dir):
    return chunking.with_offsets(line_sections(spark, sf_dir)).select("paper_id", "section_no", "base")


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.recursive_separator(sections(spark, sf_dir)).select(*OUT)


@query()
def chunk_semantic(spark, sf_dir):
    return chunking.semantic(sections(spark, sf_dir), hash_embed).select(*OUT)


@query()
def semantic_breaks(spark, sf_dir):
    """Passages that the semantic chunker makes of each document."""
    return chunk_semantic(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


@query()
def chunk_strategy_stats(spark, sf_dir):
    """Passages and mean length of every registered strategy."""
    s, out = sections(spark, sf_dir), None
    for name, cut in chunking.strategies(hash_embed).items():
        one = cut(s).agg(F.lit(name).alias("strategy"), F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH s(strategy, n_chunks, ndcg, ord) AS (SELECT source, count(*), round(avg(n_chars) / 10000.0, 6), row_number() OVER (ORDER BY source) FROM documents GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY ndcg DESC, ord) AS by_ndcg, row_number() OVER (ORDER BY ndcg / greatest(n_chunks, 1) DESC, ord) AS by_cost, count(*) OVER () AS n FROM s)
SELECT 'winner' AS role, strategy FROM r WHERE by_ndcg = 1 UNION ALL SELECT 'median', strategy FROM r WHERE by_ndcg = n // 2 + 1 UNION ALL SELECT 'efficient', strategy FROM r WHERE by_cost = 1""")
def select_variants(spark, sf_dir):
    """The best strategy, the median one, and the one with most quality for its passages."""
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("strategy")).agg(F.count("*").alias("n_chunks"), F.round(F.avg("n_chars") / 10000.0, 6).alias("ndcg"))
    return strategies_of_note(s)


def chunk_sql(name: str, size: int, step: int) -> str:
    return f"""{name}_c AS (SELECT doc_id * 1000000 + i AS id, doc_id AS paper, substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text
 FROM (SELECT *, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i FROM papers)),
{bm25_sql('text', name=name).replace('doc_id AS id', 'id').replace('FROM papers', f'FROM {name}_c')},
{name}_l AS ({rank_sql(name, 50)}), {name}_f AS (SELECT qid, paper, min(rank) AS rank FROM {name}_l JOIN {name}_c ON {name}_c.id = {name}_l.id GROUP BY qid, paper),
{name}_r AS (SELECT qid, paper AS id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM {name}_f), {metrics_sql(f'{name}_r', 10, f'{name}_m')}"""


def scored_sql(strategy: str, name: str) -> str:
    return f"SELECT '{strategy}' AS strategy, (SELECT count(*) FROM {name}_c) AS n_chunks, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM {name}_m"


@query(f"WITH {PAPERS_SQL}, {QT}, {JUDGED}, {chunk_sql('ov', 1600, 1400)}, {chunk_sql('no', 1600, 1600)} {scored_sql('fixed_overlap', 'ov')} UNION ALL {scored_sql('fixed_no_overlap', 'no')}")
def chunk_strategy_ndcg(spark, sf_dir):
    """How well each way of cutting finds the judged documents: passages ranked, rolled up to their documents, scored."""
    s, marks = sections(spark, sf_dir), judged(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("char_start")) - 1
    cut = {name: chunking.strategies(hash_embed)[name](s).select((F.col("paper_id").cast("long") * 1_000_000 + place).alias("no"), F.col("paper_id").cast("long").alias("paper"), "text") for name in ("fixed_overlap", "fixed_no_overlap")}
    return chunking_scores(cut, questions(spark, sf_dir), marks)


@query(f"""WITH {SECTIONS_SQL}, c AS (SELECT paper_id, sha256(concat(paper_id, text)) AS chunk_id, section_no FROM secs)
SELECT paper_id, chunk_id, min(section_no) AS place, max(section_no) AS kept FROM c GROUP BY paper_id, chunk_id""")
def chunk_dedup(spark, sf_dir):
    """A passage that recurs keeps its first place and its last values."""
    c = line_sections(spark, sf_dir).select("paper_id", fx.content_id("paper_id", F.col("text")).alias("chunk_id"), "section_no")
    return chunking.dedup_by_id(c, ["section_no"]).select("paper_id", "chunk_id", F.col("place.section_no").alias("place"), F.col("section_no").alias("kept"))


# Parsers.
@query("""WITH lines AS (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS z FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
l AS (SELECT doc_id, CAST(z[2] AS BIGINT) AS pos, z[1] AS line, CAST(z[2] AS BIGINT) % 4 = 0 AND length(trim(z[1])) > 0 AS h FROM lines),
r AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l),
g AS (SELECT doc_id, run, max(CASE WHEN h THEN trim(line) END) AS heading, trim(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h AND regexp_matches(line, '\\S'))) AS text FROM r GROUP BY doc_id, run)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS section_no, heading, text FROM g WHERE text IS NOT NULL""")
def parse_markdown(spark, sf_dir):
    """Documents with every fourth line made a heading."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when((i % 4 == 0) & (F.length(F.trim(line)) > 0), F.concat(F.lit("## "), line)).otherwise(line)), "\n")
    return parsers.parse_markdown(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), marked.alias("text")))


@query("SELECT CAST(doc_id AS VARCHAR) AS paper_id, 0 AS section_no, CAST(NULL AS VARCHAR) AS heading, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE regexp_matches(text, '\\S')")
def parse_txt(spark, sf_dir):
    return parsers.parse_txt(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.decode(F.encode("text", "utf-8"), "utf-8").alias("text")))


@query()
def parse_html_sections(spark, sf_dir):
    return parsers.parse_html(table(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"), "html"), "html")


@query(r"""WITH l AS (SELECT doc_id, CAST(z[2] AS BIGINT) AS pos, regexp_replace(z[1], '^\s+|\s+$', '', 'g') AS line FROM (
 SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS z FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f]', '', 'g'), chr(10)) AS l FROM documents))),
r AS (SELECT *, pos % 4 = 0 AS h, sum(CAST(pos % 4 = 0 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l WHERE line <> ''),
g AS (SELECT doc_id, run, max(CASE WHEN h THEN line END) AS heading, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h) AS text FROM r GROUP BY doc_id, run)
SELECT doc_id AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS section_no, heading, text FROM g WHERE text IS NOT NULL""")
def parse_docx(spark, sf_dir):
    """Documents written as word-processor files, every fourth line a heading, and parsed again."""

    @F.pandas_udf("binary")
    def pack(text: pd.Series) -> pd.Series:
        return text.map(docx_of)

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), pack("text").alias("content"))
    return parsers.parse_docx(files, "content")


def docx_of(text: str | None) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    clean = "".join(c for c in text or "" if c in "\n\t" or ord(c) >= 32)
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f"<w:p>{style if i % 4 == 0 else ''}<w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for i, line in enumerate(clean.split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'txt' WHEN 3 THEN 'docx' WHEN 4 THEN 'pdf' END AS parser FROM pages""")
def parser_dispatch(spark, sf_dir):
    """Parsers by file name; unknown extensions have none."""
    names = F.array(*[F.lit(x) for x in ("page.HTML", "Notes.md", "a.b.TXT", "x.docx", "y.Pdf", "z.zip")])
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", parsers.parser_name(names[(F.col("page_id") % 6).cast("int")]).alias("parser"))


@query("""SELECT doc_id, concat('2301.', CAST(10000 + doc_id AS VARCHAR)) AS arxiv_id, concat('Title of ', source) AS title, source AS authors,
 concat(lang, ';', source) AS category, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published_date, concat('http://host/pdf/', CAST(doc_id AS VARCHAR)) AS pdf_url FROM documents""")
def atom_entry_parse(spark, sf_dir):
    """Entries of a feed, made of the documents' metadata."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    xml = F.format_string(
        "<entry><id>http://host/abs/2301.%sv2</id><title>Title\n  of   %s</title><summary> a  b </summary><author><name> %s </name></author><category term=\"%s\"/><category term=\"%s\"/><published>%sT10:00:00Z</published><link title=\"html\" href=\"no\"/><link title=\"pdf\" href=\"http://host/pdf/%s\"/></entry>",
        (F.col("doc_id") + 10000).cast("string"), "source", "source", "lang", "source", day, F.col("doc_id").cast("string"),
    )
    cols = parsers.atom_entry(F.col("xml"))
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")).select("doc_id", *[cols[c].alias(c) for c in ("arxiv_id", "title", "authors", "category", "published_date", "pdf_url")])


@query("""WITH l AS (SELECT l_orderkey AS paper_id, l_linenumber AS pos, (l_linenumber + 1) // 2 AS page, CASE WHEN l_returnflag = 'A' THEN concat('Part ', CAST(l_linenumber AS VARCHAR)) ELSE concat('line of ', CAST(l_linenumber AS VARCHAR), '.') END AS line,
 CASE WHEN l_returnflag = 'A' THEN 14.0 ELSE 10.0 END AS size FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)),
c AS (SELECT paper_id, size, count(*) AS n, min(pos) AS seen FROM l GROUP BY paper_id, size),
b AS (SELECT paper_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1),
h AS (SELECT l.*, size >= body * 1.15 AND NOT regexp_matches(line, '[.,;]$') AND length(line) <= 80 AS h FROM l JOIN b ON l.paper_id = b.paper_id),
r AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY paper_id ORDER BY pos) AS run FROM h)
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY run) - 1 AS section_no, heading, text, page FROM (
 SELECT paper_id, run, max(CASE WHEN h THEN line END) AS heading, string_agg(line, ' ' ORDER BY pos) FILTER (WHERE NOT h) AS text, arg_min(page, pos) AS page FROM r GROUP BY paper_id, run) WHERE text IS NOT NULL""")
def layout_sections(spark, sf_dir):
    """Lines with sizes and pages (order lines stand in for them) to sections."""
    flag = F.col("l_returnflag") == "A"
    no = F.col("l_linenumber").cast("string")
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    lines = once.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("pos"), F.floor((F.col("l_linenumber") + 1) / 2).alias("page"), F.when(flag, F.concat(F.lit("Part "), no)).otherwise(F.concat(F.lit("line of "), no, F.lit("."))).alias("line"), F.when(flag, 14.0).otherwise(10.0).alias("size"))
    return parsers.layout_sections(lines)


# Evidence.
@query(f"""WITH {TURNS_SQL} SELECT conv_id, turn, regexp_matches(query, '(?i)\\b(the model|the framework|the system|the approach|the method|the baseline|the paper|the algorithm|it|its)\\b')
 AND NOT regexp_matches(query, '(?i)\\b({"|".join(fx.ENTITY_NAMES)})\\b') AND NOT regexp_matches(query, '\\b\\d{{4}}\\.\\d{{4,5}}\\b') AS flagged
 FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat(query, ' it') WHEN 1 THEN concat(query, ' Its GEM') WHEN 2 THEN concat(query, ' the model 2301.12345') ELSE concat(query, ' management') END AS query FROM turns)""")
def unresolved_reference(spark, sf_dir):
    """Questions with endings that do or do not resolve a generic reference."""
    tail = F.element_at(F.array(*[F.lit(x) for x in (" it", " Its GEM", " the model 2301.12345", " management")]), (F.col("turn") % 4 + 1).cast("int"))
    return turns(spark, sf_dir).select("conv_id", "turn", fx.unresolved_reference(F.concat("query", tail)).alias("flagged"))


@query("""SELECT o_orderkey, o_custkey > o_orderkey AND o_custkey <> 7 AS flagged, CASE WHEN o_custkey > o_orderkey AND o_custkey <> 7 THEN o_custkey END AS first_number
FROM orders""")
def numeric_transposition(spark, sf_dir):
    """Questions whose two numbers the context has in the other order (in ascending order here)."""
    o = table(spark, sf_dir, "orders")
    asked = F.format_string("Are there %,d states from %d questions?", F.col("o_custkey"), F.col("o_orderkey"))
    context = F.format_string("In 7 parts, %d states from %d questions", F.least("o_custkey", "o_orderkey"), F.greatest("o_custkey", "o_orderkey"))
    hit = fx.transposed(asked, context)
    return o.select("o_orderkey", hit.isNotNull().alias("flagged"), hit["a"].alias("first_number"))


@query(f"""WITH {RERANKED}, top AS (SELECT qid, count(DISTINCT id % 20) AS n_papers, count(DISTINCT CASE WHEN new_rank <= 3 THEN id % 20 END) AS top_papers, count(CASE WHEN new_rank <= 3 THEN 1 END) AS top_n FROM rr GROUP BY qid)
SELECT qid, n_papers, n_papers >= 3 AND NOT (top_papers = 1 AND top_n = 3) AS flagged FROM top""")
def ambiguity_diversity(spark, sf_dir):
    """The best passages span three papers or more, and the first three do not agree on one."""
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir)).withColumn("paper", F.col("id") % 20)
    first = F.when(F.col("new_rank") <= 3, F.col("paper"))
    a = r.groupBy("qid").agg(F.count_distinct("paper").alias("n_papers"), F.count_distinct(first).alias("top_papers"), F.count(first).alias("top_n"))
    return a.select("qid", "n_papers", ((F.col("n_papers") >= 3) & ~((F.col("top_papers") == 1) & (F.col("top_n") == 3))).alias("flagged"))


def numbers_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: CAST(floor(CAST(replace(n, ',', '') AS DOUBLE)) AS BIGINT))"


def pairs_sql(text: str) -> str:
    n = numbers_sql(text)
    return f"CASE WHEN len({n}) < 2 THEN [] ELSE list_transform(range(1, len({n})), lambda i: {{'a': ({n})[i], 'b': ({n})[i + 1]}}) END"


GENERIC, NAMES = "|".join(fx.GENERIC_NAMES), "|".join(fx.ENTITY_NAMES)


def note_sql(query_: str, context: str, papers_: str) -> str:
    """The first of four reasons: a judge's note, numbers in the other order, an unresolved reference, a spread over papers.
    ``papers_`` is the list of the passages' papers in order."""
    own, other = pairs_sql(query_), pairs_sql(context)
    return f"""CASE WHEN len(list_filter({own}, lambda p: p.a <> p.b AND list_contains({other}, {{'a': p.b, 'b': p.a}}) AND NOT list_contains({other}, p))) > 0 THEN 'transposition'
 WHEN regexp_matches({query_}, '(?i)\\b({GENERIC})\\b') AND NOT regexp_matches({query_}, '(?i)\\b({NAMES})\\b') AND NOT regexp_matches({query_}, '\\b\\d{{4}}\\.\\d{{4,5}}\\b') THEN 'reference'
 WHEN len(list_distinct({papers_})) >= 3 AND NOT (len({papers_}) >= 3 AND len(list_distinct(list_slice({papers_}, 1, 3))) = 1) THEN 'diversity' END"""


# A judge's notes, and questions with two numbers, some of which their papers have in the other order.
JUDGED_QUERY = "concat(query, CASE qid % 4 WHEN 0 THEN ' from 17 of 4,512 parts' WHEN 1 THEN ' and its end' ELSE '' END)"


@query(f"""WITH {RERANKED}, c AS (SELECT qid, {JUDGED_QUERY} AS query, string_agg(CASE WHEN new_rank = 2 AND qid % 8 = 0 THEN concat(text, ' 4,512 from 17') ELSE text END, ' ' ORDER BY new_rank) AS context, list(id % 20 ORDER BY new_rank) AS ps FROM rr GROUP BY qid, query)
SELECT qid, CASE WHEN qid % 9 = 3 THEN 'unclear' ELSE {note_sql('query', 'context', 'ps')} END AS note FROM c""")
def ambiguity_signal(spark, sf_dir):
    """The first reason to ask back, of four: a judge's note, transposed numbers, an unresolved reference, a spread over papers."""
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir))
    text = F.when((F.col("new_rank") == 2) & (F.col("qid") % 8 == 0), F.concat("text", F.lit(" 4,512 from 17"))).otherwise(F.col("text"))
    item = F.struct(F.col("new_rank").cast("long").alias("new_rank"), F.col("id").cast("long").alias("id"), text.alias("text"), (F.col("id") % 20).cast("long").alias("paper"))
    c = r.groupBy("qid", "query").agg(F.sort_array(F.collect_list(item)).alias("context"))
    judge = F.when(F.col("qid") % 9 == 3, "unclear")
    return c.select("qid", ambiguity(F.expr(JUDGED_QUERY), F.col("context"), judge).alias("note"))


@query(f"""WITH {RERANKED}, c AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN concat(left(query, 9), ' tungsten graphite basalt quartz') ELSE query END AS query, string_agg(text, ' ' ORDER BY new_rank) AS context FROM rr GROUP BY qid, query),
s AS (SELECT qid, round({overlap_sql('query', 'context')}, 6) AS overlap FROM c) SELECT qid, overlap, overlap >= 0.4545 OR CASE qid % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS passed FROM s""")
def context_sufficiency(spark, sf_dir):
    """Whether the context holds enough of the question's tokens; else a judge says yes or no, or cannot be asked (every fourth)."""
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir))
    asked = F.when(F.col("qid") % 3 == 0, F.concat(F.expr("left(query, 9)"), F.lit(" tungsten graphite basalt quartz"))).otherwise(F.col("query"))
    c = r.groupBy("qid", "query").agg(F.collect_list(F.struct("text", fx.tokens("text").alias("tokens"))).alias("context")).withColumn("own", fx.tokens(asked))
    judge = F.when(F.col("qid") % 4 != 2, F.col("qid") % 4 == 0)
    return c.select("qid", F.round(shared(F.col("own"), F.col("context")), 6).alias("overlap"), sufficient(F.col("own"), F.col("context"), judge).alias("passed"))


def context_of(order: str, joiner: str):
    """Texts of a group in order; the group is a ranked list that was cut before."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), joiner)


@query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, round({overlap_sql('answer', 'query')}, 6) AS overlap, answer LIKE 'I don''t have enough%' AS abstained FROM turns)
SELECT conv_id, turn, overlap, abstained OR overlap >= 0.5 AS passed FROM s""")
def groundedness(spark, sf_dir):
    """An answer is grounded if it abstains or its tokens are in the context; errors would fail it."""
    t = turns(spark, sf_dir).withColumn("overlap", F.round(fx.overlap("answer", "query"), 6))
    return t.select("conv_id", "turn", "overlap", (F.col("answer").startswith("I don't have enough") | (F.col("overlap") >= 0.5)).alias("passed"))


@query(f"WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, round({overlap_sql('answer', 'query')}, 6) AS overlap FROM turns) SELECT conv_id, turn, 'groundedness' AS guardrail, concat('overlap below ', '0.5') AS reason FROM s WHERE overlap < 0.5")
def guardrail_events(spark, sf_dir):
    """Checks that failed; those that passed leave no event."""
    return groundedness(spark, sf_dir).where("not passed").select("conv_id", "turn", F.lit("groundedness").alias("guardrail"), F.lit("overlap below 0.5").alias("reason"))


ANSWERS_SQL = f"""{TURNS_SQL}, a AS (SELECT conv_id, turn, query, CASE turn % 5 WHEN 0 THEN concat(answer, ' [1] and [3†L1-L4] [1]') WHEN 1 THEN concat(answer, ' 【2】 ［9］ [unclear]')
 WHEN 2 THEN concat('I don''t have enough information in the retrieved context to answer this.', answer) WHEN 3 THEN concat(answer, ' which one?') ELSE concat(answer, ' [DECLINED_TO_GUESS]') END AS raw FROM turns),
p AS (SELECT conv_id, turn, query, suffix(raw, '[DECLINED_TO_GUESS]') AS tagged,
 translate(CASE WHEN suffix(raw, '[DECLINED_TO_GUESS]') THEN rtrim(left(raw, length(raw) - 19)) ELSE raw END, '【】［］', '[][]') AS text FROM a),
k AS (SELECT *, starts_with(text, 'I don''t have enough information in the retrieved context to answer this.') AS abstained,
 list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d+)[^\\[\\]]*\\]', 1), lambda x: CAST(x AS BIGINT)))) AS marks FROM p)"""


def answers(spark, sf_dir) -> DataFrame:
    """Answers in the shapes that models give: citations of several kinds, abstentions, questions, tags."""
    kinds = [F.concat("answer", F.lit(" [1] and [3†L1-L4] [1]")), F.concat("answer", F.lit(" 【2】 ［9］ [unclear]")), F.concat(F.lit(fx.ABSTAIN_TEXT), "answer"), F.concat("answer", F.lit(" which one?")), F.concat("answer", F.lit(" " + fx.DECLINE_TAG))]
    raw = turns(spark, sf_dir).withColumn("raw", F.element_at(F.array(*kinds), (F.col("turn") % 5 + 1).cast("int")))
    tagged = F.col("raw").endswith(fx.DECLINE_TAG)
    plain = F.when(tagged, F.rtrim(F.expr(f"left(raw, length(raw) - {len(fx.DECLINE_TAG)})"))).otherwise(F.col("raw"))
    out = raw.select("conv_id", "turn", "query", tagged.alias("tagged"), fx.plain_brackets(plain).alias("text"))
    return out.withColumn("abstained", F.col("text").startswith(fx.ABSTAIN_TEXT)).withColumn("marks", fx.cited("text"))


@query(f"WITH {ANSWERS_SQL} SELECT conv_id, turn, text, tagged, abstained FROM k")
def answer_postprocess(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", "text", "tagged", "abstained")


@query(f"WITH {ANSWERS_SQL} SELECT conv_id, turn, array_to_string(list_filter(marks, lambda i: i BETWEEN 1 AND 8), ',') AS cited FROM k WHERE NOT abstained")
def citation_extract(spark, sf_dir):
    """Passage numbers that an answer cites, of eight passages."""
    kept = F.filter("marks", lambda i: i.between(1, 8))
    return answers(spark, sf_dir).where("not abstained").select("conv_id", "turn", F.array_join(F.transform(kept, lambda i: i.cast("string")), ",").alias("cited"))


@query(f"""WITH {ANSWERS_SQL}, c AS (SELECT conv_id, turn, unnest(marks) AS mark FROM k),
ctx AS (SELECT conv_id, turn AS mark FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.turn, count(*) FILTER (WHERE x.mark IS NOT NULL) AS valid, count(*) FILTER (WHERE x.mark IS NULL) AS stripped FROM c LEFT JOIN (SELECT DISTINCT * FROM ctx) x ON c.conv_id = x.conv_id AND c.mark = x.mark GROUP BY c.conv_id, c.turn""")
def citation_integrity(spark, sf_dir):
    """Citations that resolve to the context, and those to strip."""
    c = answers(spark, sf_dir).select("conv_id", "turn", F.explode("marks").alias("mark"))
    x = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("mark")).distinct().withColumn("there", F.lit(1))
    return c.join(x, ["conv_id", "mark"], "left").groupBy("conv_id", "turn").agg(F.count("there").alias("valid"), F.count_if(F.col("there").isNull()).alias("stripped"))


@query(f"""WITH {ANSWERS_SQL} SELECT conv_id, turn, turn % 2 = 1 AND NOT abstained AND (tagged OR len(marks) = 0 OR suffix(text, '?')
 OR regexp_matches(text, '(?i)premise.{{0,60}}(conflict|contradict|incorrect|is wrong|reversed|opposite|false)')
 OR (regexp_matches(text, '(?i)\\b(do not|does not|doesn''t|no mention|not addressed|not discussed|not report|not claim|not describe)\\b') AND regexp_matches(text, '(?i)\\b(context|passages?)\\b'))) AS declined FROM k""")
def declined_to_guess(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("conv_id", "turn", fx.declined(F.col("text"), F.col("turn") % 2 == 1, F.col("abstained"), F.col("tagged"), F.size("marks")).alias("declined"))


@query(f"""WITH {RERANKED} SELECT r.qid, sha256(string_agg(concat('[', CAST(new_rank AS VARCHAR), '] (from "', CASE WHEN r.id % 9 = 0 THEN 'unknown paper' ELSE p.title END, '"): ', r.text), chr(10) || chr(10) ORDER BY new_rank)) AS context_sha
 FROM rr r JOIN papers p ON p.doc_id = r.id GROUP BY r.qid""")
def context_assembly(spark, sf_dir):
    """The numbered context of a prompt; a missing title is named so."""
    title = F.coalesce(F.when(F.col("id") % 9 != 0, F.substring_index("text", "\n", 1)), F.lit("unknown paper"))
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir))
    lines = r.select("qid", "new_rank", F.concat(F.lit("["), F.col("new_rank").cast("string"), F.lit('] (from "'), title, F.lit('"): '), "text").alias("text"))
    return lines.groupBy("qid").agg(F.sha2(context_of("new_rank", "\n\n"), 256).alias("context_sha"))


@query(f"WITH {RERANKED} SELECT qid, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS n_words, count(DISTINCT paper_id) AS n_papers FROM rr GROUP BY qid")
def context_word_count(spark, sf_dir):
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir))
    return r.groupBy("qid").agg(F.sum(fx.word_count("text")).alias("n_words"), F.count_distinct("id").alias("n_papers"))


# Questions as they are, without text, that nothing answers, out of scope, and that a few passages hold in part.
ASKED = "CASE item_id % 6 WHEN 1 THEN '' WHEN 2 THEN 'Tungsten graphite basalt quartz cobalt mercury' WHEN 4 THEN concat(text, ' tungsten graphite basalt quartz cobalt mercury of the model') WHEN 5 THEN concat(left(text, 12), ' tungsten graphite basalt quartz cobalt mercury') ELSE text END"


def attempt_sql(n: int, size: int) -> str:
    own = f"list_filter(x, lambda i: i.r <= {size})"
    return f"""c{n} AS (SELECT qid, query, {own} AS x, array_to_string(list_transform({own}, lambda i: i.t), ' ') AS context, list_transform({own}, lambda i: i.p) AS ps FROM asked),
h{n} AS (SELECT *, list_filter(x, lambda i: len(list_intersect({tokens_sql('i.t')}, {tokens_sql('query')})) > 0) AS hits FROM c{n}),
s{n} AS (SELECT *, CASE WHEN len(hits) > 0 THEN concat(regexp_extract(hits[1].t, '(?s)^(.*?[.!?]|.*)(\\s|$)', 1), ' [', hits[1].r, ']') ELSE '{fx.ABSTAIN_TEXT.replace("'", "''")}' END AS said FROM h{n}),
a{n} AS (SELECT qid, said, len(x) > 0 AND {overlap_sql('query', 'context')} >= 0.4545 AS sufficient, len(hits) = 0 OR starts_with(said, '{fx.ABSTAIN_TEXT.replace("'", "''")}') AS abstained,
 list_sort(list_distinct(list_transform(regexp_extract_all(said, '\\[(\\d+)[^\\[\\]]*\\]', 1), lambda m: CAST(m AS BIGINT)))) AS marks, len(x) AS n_context, {overlap_sql('said', 'context')} >= 0.5 AS held, {note_sql('query', 'context', 'ps')} AS note FROM s{n})"""


RANKED16 = RERANKED.replace("new_rank <= 8", "new_rank <= 16")
ANSWERED = f"""{RANKED16}, sixteen AS (SELECT qid, list(struct_pack(r := new_rank, t := text, p := id) ORDER BY new_rank) AS x FROM rr GROUP BY qid),
asked AS (SELECT item_id AS qid, {ASKED} AS query, item_id % 6 = 3 AS off, coalesce(x, []) AS x FROM benchmark LEFT JOIN sixteen ON qid = item_id),
{attempt_sql(1, 8)}, {attempt_sql(2, 12)},
fold AS (SELECT q.qid, length(q.query) BETWEEN 1 AND 2000 AS fits, NOT q.off AS scope, NOT a1.sufficient AS skips, NOT a1.sufficient OR a1.abstained OR NOT (a1.abstained OR a1.held) AS again FROM asked q JOIN a1 ON a1.qid = q.qid),
last AS (SELECT f.*, CASE WHEN again THEN a2 ELSE a1 END AS a FROM fold f JOIN a1 ON a1.qid = f.qid JOIN a2 ON a2.qid = f.qid),
done AS (SELECT *, fits AND scope AS ran, a.abstained OR a.held AS grounded, len(a.marks) AS n_marks, len(list_filter(a.marks, lambda m: m BETWEEN 1 AND a.n_context)) AS n_valid FROM last),
named AS (SELECT *, CASE WHEN NOT fits THEN 'too_large' WHEN NOT scope THEN 'out_of_scope' WHEN NOT grounded THEN 'ungrounded' WHEN a.abstained THEN 'abstained' ELSE 'answered' END AS outcome FROM done),
answered AS (SELECT qid, CASE outcome WHEN 'answered' THEN a.said WHEN 'too_large' THEN '{fx.TOO_LARGE_TEXT.replace("'", "''")}' WHEN 'ungrounded' THEN '{fx.UNGROUNDED_TEXT.replace("'", "''")}' ELSE '{fx.ABSTAIN_TEXT.replace("'", "''")}' END AS text,
 outcome <> 'answered' AS abstained, CASE WHEN outcome = 'answered' THEN n_valid ELSE 0 END AS n_citations, CASE WHEN outcome = 'answered' THEN n_marks - n_valid ELSE 0 END AS stripped,
 CASE WHEN ran THEN a.sufficient END AS sufficient, CASE WHEN ran THEN grounded END AS grounded, CASE WHEN ran THEN a.note END AS note,
 CASE WHEN NOT ran THEN 0 WHEN again THEN 2 ELSE 1 END AS attempts, CASE WHEN NOT ran THEN 0 WHEN again AND NOT skips THEN 2 ELSE 1 END AS generated, CASE WHEN ran AND skips THEN 1 ELSE 0 END AS saved, outcome FROM named)"""


def answered(spark, sf_dir, down=None) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    asked = b.select(F.col("item_id").alias("qid"), F.expr(ASKED).alias("query"), F.when(F.col("item_id") % 6 == 3, "out_of_scope").alias("intent"), *([] if down is None else [down.alias("down")]))
    r = reranked(fused(spark, sf_dir), papers(spark, sf_dir), questions(spark, sf_dir), 16)
    return answer_questions(asked, r, "enforce")


@query(f"WITH {ANSWERED} SELECT * FROM answered")
def answer_batch(spark, sf_dir):
    """Every question end to end: guard, retrieve, rerank, assess, answer, try again, or decline."""
    return answered(spark, sf_dir).drop("trace")


@query(f"""WITH {ANSWERED}, t AS (SELECT qid, to_json(struct_pack(text := text, abstained := abstained, n_citations := n_citations, note := note, attempts := attempts, outcome := outcome)) AS trace FROM answered)
SELECT sha256(concat(CAST(qid AS VARCHAR), '|', trace)) AS run_id, qid, CAST(trace AS VARCHAR) AS trace FROM t""")
def run_log(spark, sf_dir):
    """A record for each question, the trace as JSON, named by its content, kept in a store: saving it again adds nothing."""
    fields = F.struct("text", "abstained", "n_citations", "note", "attempts", "outcome")
    rows = answered(spark, sf_dir).select("qid", F.to_json(fields, {"ignoreNullFields": "false"}).alias("trace"))
    rows = stored(rows.select(F.sha2(F.concat_ws("|", F.col("qid").cast("string"), "trace"), 256).alias("run_id"), "qid", "trace"))
    log = Store(spark, scratch_path(spark, "runs"), ["run_id"], 8).create(rows.limit(0))
    for _ in range(2):
        log.insert_if_absent(rows, ["run_id"])
    return log.read()


@query(f"""WITH {ANSWERED}, o AS (SELECT CASE qid % 3 WHEN 0 THEN 'false_premise' WHEN 1 THEN 'out_of_corpus' ELSE 'under_specified' END AS kind, CASE WHEN qid % 7 = 0 AND outcome NOT IN ('too_large', 'out_of_scope') THEN 'failed' ELSE outcome END AS outcome FROM answered)
SELECT kind, count(*) FILTER (WHERE outcome <> 'failed') AS n, count(*) FILTER (WHERE outcome = 'failed') AS n_failed, round(avg(CASE WHEN outcome <> 'failed' THEN CAST(outcome <> 'answered' AS DOUBLE) END), 6) AS refusal_rate FROM o GROUP BY ROLLUP (kind)""")
def abstention_rollup(spark, sf_dir):
    """Refusals by kind and overall; questions that the service failed on are counted apart."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("false_premise", "out_of_corpus", "under_specified")]), (F.col("qid") % 3 + 1).cast("int"))
    return refusals(answered(spark, sf_dir, F.col("item_id") % 7 == 0).withColumn("kind", kind))


@query("""WITH r AS (SELECT source, CASE WHEN max(doc_id) % 5 = 0 THEN NULL ELSE round(avg(CAST(n_chars % 2 = 0 AS DOUBLE)), 6) END AS rate FROM documents GROUP BY source)
SELECT source, rate, CASE WHEN rate IS NULL THEN 'not run' WHEN rate >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS higher, CASE WHEN rate IS NULL THEN 'not run' WHEN rate <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS lower FROM r""")
def gate_verdict(spark, sf_dir):
    """A rate against a threshold, from above and from below; a missing rate was not run."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg((F.col("n_chars") % 2 == 0).cast("double")), 6).alias("r"), F.max("doc_id").alias("m"))
    d = d.select("source", F.when(F.col("m") % 5 != 0, F.col("r")).alias("rate"))
    return d.select("source", "rate", gate(F.col("rate"), 0.5).alias("higher"), gate(F.col("rate"), 0.5, False).alias("lower"))
