"""Filters, joins, set operations, mutations and lookups."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.adapters import PAPERS_SQL, VECTORS_SQL, papers, table, vectors
from spindrift.catalog.base import query
from spindrift.functions.embedding import hash_embed
from spindrift.functions.text import content_id
from spindrift.operators import store
from spindrift.operators.chunking import fixed_windows
from spindrift.operators.dense import cosine_topk
from spindrift.operators.filters import Filters, author_contains, author_tokens, categories, condition, visible
from spindrift.plans.reindex import reindex
from spindrift.session import scratch_path

CHUNKS_SQL = f"""{PAPERS_SQL}, chunks AS (
  SELECT paper_id, owner, doc_id, i * 1400 AS char_start, substr(text, CAST(i * 1400 + 1 AS BIGINT), 1600) AS text,
         i * 1400 + length(substr(text, CAST(i * 1400 + 1 AS BIGINT), 1600)) AS char_end,
         sha256(concat(paper_id, substr(text, CAST(i * 1400 + 1 AS BIGINT), 1600))) AS chunk_id
  FROM (SELECT *, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1600 THEN 1
        ELSE CAST(ceil((length(text) - 1600) / 1400.0) AS BIGINT) + 1 END)) AS i FROM papers))"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("heading"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_windows(sections(spark, sf_dir))


def stored(df: DataFrame, by: list[str], change=None) -> DataFrame:
    """A store of ``df``, and after a mutation of it: run twice, which changes nothing further."""
    held = store.Store(df.sparkSession, scratch_path(df.sparkSession, "store"), by, 8).create(df)
    for _ in range(2 if change else 0):
        change(held)
    return held.read()


@query(f"WITH {PAPERS_SQL} SELECT 's1' AS session, paper_id FROM papers WHERE owner IS NULL OR owner = 's1' UNION ALL SELECT 'none', paper_id FROM papers WHERE owner IS NULL")
def filter_owner_visibility(spark, sf_dir):
    p = papers(spark, sf_dir)
    one = p.where(visible(F.col("owner"), "s1")).select(F.lit("s1").alias("session"), "paper_id")
    return one.unionByName(p.where(visible(F.col("owner"), None)).select(F.lit("none").alias("session"), "paper_id"))


@query(f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE list_has_any(regexp_extract_all(lower(array_to_string(authors, ' ')), '[a-z0-9]+'), ['src3', 'src7'])")
def filter_author_tokens(spark, sf_dir):
    return papers(spark, sf_dir).where(author_tokens("authors", "SRC3 or src7")).select("paper_id")


@query(f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE concat('[\"', array_to_string(authors, '\",\"'), '\"]') ILIKE '%rc1%'")
def filter_author_ilike(spark, sf_dir):
    return papers(spark, sf_dir).where(author_contains("authors", "rc1")).select("paper_id")


@query(f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE list_contains(category, 'fr')")
def filter_category(spark, sf_dir):
    return papers(spark, sf_dir).where(F.array_contains("category", "fr")).select("paper_id")


@query(f"WITH {PAPERS_SQL} SELECT paper_id, published_date FROM papers WHERE published_date >= DATE '2024-03-01' AND published_date <= DATE '2024-04-30'")
def filter_date_range(spark, sf_dir):
    return papers(spark, sf_dir).where(condition(Filters(date_from="2024-03-01", date_to="2024-04-30")) | F.col("owner").isNotNull() & F.col("published_date").between("2024-03-01", "2024-04-30")).select("paper_id", "published_date")


@query(f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE list_contains(category, 'en') AND list_contains(authors, 'src2') AND published_date >= DATE '2024-02-01' AND owner IS NULL")
def filter_conjunction(spark, sf_dir):
    return papers(spark, sf_dir).where(condition(Filters(category="en", author="src2", date_from="2024-02-01"))).select("paper_id")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, char_start FROM chunks WHERE paper_id = '17' AND (owner IS NULL OR owner = 's2')")
def filter_document_scope(spark, sf_dir):
    p = papers(spark, sf_dir).where(condition(Filters(document="17", session="s2")))
    return fixed_windows(p.select("paper_id", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("heading"), "text")).select("chunk_id", "char_start")


@query(f"WITH {PAPERS_SQL}, c AS (SELECT DISTINCT unnest(category) AS category FROM papers WHERE owner IS NULL) SELECT category FROM c")
def distinct_categories(spark, sf_dir):
    return categories(papers(spark, sf_dir))


@query(f"""WITH {PAPERS_SQL}, known AS (SELECT DISTINCT unnest(category) AS c FROM papers WHERE owner IS NULL)
SELECT vec_id AS qid, CASE WHEN k.c IS NULL THEN NULL ELSE asked END AS category, author FROM (
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN concat('src', CAST(vec_id % 40 AS VARCHAR)) ELSE 'cs.ZZ' END AS asked,
         concat('src', CAST(label AS VARCHAR)) AS author FROM embeddings) q LEFT JOIN known k ON q.asked = k.c""")
def sanitize_category(spark, sf_dir):
    """A category that no shared document has is dropped from a filter; other filters stay."""
    asked = vectors(spark, sf_dir).select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("src"), (F.col("vec_id") % 40).cast("string"))).otherwise("cs.ZZ").alias("asked"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("author"))
    known = distinct_categories(spark, sf_dir).withColumnRenamed("category", "known")
    return asked.join(known, F.col("asked") == F.col("known"), "left").select("qid", F.when(F.col("known").isNotNull(), F.col("asked")).alias("category"), "author")


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 2000 AS passed FROM conversations")
def guard_size_shape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").between(1, 2000).alias("passed"))


@query("SELECT item_id AS qid, CASE WHEN item_id % 7 = 0 THEN 'out_of_scope' ELSE 'factual' END AS intent, item_id % 7 <> 0 AS passed FROM benchmark")
def guard_scope(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 7 == 0, "out_of_scope").otherwise("factual").alias("intent"))
    return q.withColumn("passed", F.col("intent") != "out_of_scope")


@query("""WITH runs AS (SELECT DISTINCT conv_id AS run_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE concat('s', CAST(conv_id % 3 AS VARCHAR)) END AS owner FROM conversations)
SELECT run_id, coalesce(owner IS NULL OR owner = 's1', false) AS found FROM runs""")
def run_replay_visibility(spark, sf_dir):
    """A run is found by its owner or if it is shared; a foreign one looks as if it were missing."""
    runs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id")).distinct().withColumn("owner", F.when(F.col("run_id") % 4 != 0, F.concat(F.lit("s"), (F.col("run_id") % 3).cast("string"))))
    return runs.select("run_id", F.coalesce(visible(F.col("owner"), "s1"), F.lit(False)).alias("found"))


@query(f"WITH {CHUNKS_SQL} SELECT c.chunk_id, c.paper_id, p.title, c.char_start FROM chunks c JOIN papers p ON c.paper_id = p.paper_id")
def join_chunk_paper(spark, sf_dir):
    return chunks(spark, sf_dir).join(papers(spark, sf_dir).select("paper_id", "title"), "paper_id").select("chunk_id", "paper_id", "title", "char_start")


@query(f"""WITH {CHUNKS_SQL} SELECT p.paper_id, count(c.chunk_id) AS n_chunks, any_value(p.published_date) AS published_date,
 any_value(array_to_string(list_sort(p.category), ',')) AS categories
 FROM papers p LEFT JOIN chunks c ON p.paper_id = c.paper_id WHERE p.owner IS NULL GROUP BY p.paper_id""")
def corpus_overview(spark, sf_dir):
    """Shared documents with their passages counted, 0 for none."""
    p = papers(spark, sf_dir).where("owner is null")
    n = chunks(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("n"))
    return p.join(n, "paper_id", "left").select("paper_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), "published_date", F.array_join(F.array_sort("category"), ",").alias("categories"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, paper_id FROM chunks WHERE paper_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)")
def semi_in_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("paper_id"))
    return chunks(spark, sf_dir).join(ids, "paper_id", "left_semi").select("chunk_id", "paper_id")


@query(f"WITH {CHUNKS_SQL}, held AS (SELECT DISTINCT chunk_id FROM chunks WHERE doc_id % 3 = 0) SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM held)")
def chunk_antijoin_new(spark, sf_dir):
    """Passages that the store does not have yet, once each."""
    every = chunks(spark, sf_dir).select("chunk_id", "paper_id")
    held = every.where(F.col("paper_id").cast("long") % 3 == 0).select("chunk_id").distinct().withColumn("batch", F.lit(1))
    now = stored(held, ["chunk_id"], lambda at: at.insert_if_absent(every.select("chunk_id", F.lit(2).alias("batch")), ["chunk_id"]))
    return now.where("batch = 2").select("chunk_id")


@query("""WITH held AS (SELECT doc_id, 'old' AS title FROM documents WHERE doc_id % 4 = 0),
new AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)
SELECT * FROM held UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM held)""")
def insert_if_absent(spark, sf_dir):
    """Rows already there are never changed."""
    d = table(spark, sf_dir, "documents")
    held = d.where("doc_id % 4 = 0").select("doc_id", F.lit("old").alias("title"))
    new = d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return stored(held, ["doc_id"], lambda now: now.insert_if_absent(new, ["doc_id"]))


@query(f"WITH {CHUNKS_SQL} SELECT c.chunk_id, c.paper_id, p.title, array_to_string(p.category, ',') AS category, p.published_date, v.vec_id IS NOT NULL AS has_vector FROM chunks c JOIN papers p ON c.paper_id = p.paper_id LEFT JOIN embeddings v ON v.vec_id = p.doc_id")
def index_build(spark, sf_dir):
    """Documents of a search index: passages with the metadata of their paper, and whether a vector exists."""
    p = papers(spark, sf_dir).select("paper_id", "title", "category", "published_date", "doc_id")
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("held"))
    return chunks(spark, sf_dir).join(p, "paper_id").join(v, "doc_id", "left").select("chunk_id", "paper_id", "title", F.array_join("category", ",").alias("category"), "published_date", F.coalesce("held", F.lit(False)).alias("has_vector"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels)")
def point_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""WITH {CHUNKS_SQL}, fresh AS (SELECT chunk_id, paper_id, 'v2' AS version FROM chunks WHERE char_start = 1400 AND doc_id % 2 = 0),
old AS (SELECT chunk_id, paper_id, char_start, 'v1' AS version FROM chunks)
SELECT chunk_id, paper_id, version FROM old WHERE NOT (char_start = 1400 AND paper_id IN (SELECT paper_id FROM fresh)) UNION ALL SELECT chunk_id, paper_id, version FROM fresh""")
def page_replace(spark, sf_dir):
    """Passages of one page of some documents are replaced; all others stay."""
    old = chunks(spark, sf_dir).select("chunk_id", "paper_id", "char_start", F.lit("v1").alias("version"))
    new = old.where((F.col("char_start") == 1400) & (F.col("paper_id").cast("long") % 2 == 0)).withColumn("version", F.lit("v2"))
    return stored(old, ["paper_id"], lambda now: now.replace_groups(new, ["paper_id", "char_start"])).select("chunk_id", "paper_id", "version")


@query(f"""WITH {CHUNKS_SQL}, gone AS (SELECT paper_id FROM papers WHERE list_contains(authors, 'src1') AND published_date < DATE '2024-06-01')
SELECT paper_id, chunk_id FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM gone)""")
def ttl_purge(spark, sf_dir):
    """Uploads past their time go, with all their passages."""
    expired = F.array_contains("authors", "src1") & (F.col("published_date") < "2024-06-01")
    parents = store.Store(spark, scratch_path(spark, "store"), ["paper_id"], 8).create(papers(spark, sf_dir).select("paper_id", "authors", "published_date"))
    return stored(chunks(spark, sf_dir).select("paper_id", "chunk_id"), ["paper_id"], lambda now: parents.purge(expired, now, ["paper_id"]))


@query("""SELECT d.doc_id, coalesce(CASE WHEN e.vec_id % 5 <> 0 THEN e.label END, -1) AS label, e.vec_id IS NULL OR e.vec_id % 5 = 0 AS filled
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def backfill_missing(spark, sf_dir):
    """Rows without a value get one; rows that have one are left alone."""
    v = table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").withColumn("filled", F.col("label").isNull())
    return stored(d, ["doc_id"], lambda now: now.backfill(d.where("filled").select("doc_id", F.lit(-1).cast("long").alias("label")), ["doc_id"], "label", batch=3))


@query(f"WITH {CHUNKS_SQL} SELECT 'fixed_overlap' AS strategy, chunk_id FROM chunks UNION ALL SELECT 'short' AS strategy, chunk_id FROM chunks WHERE char_start = 0")
def persist_variant(spark, sf_dir):
    """Passages by the strategy that made them; writing one strategy anew replaces only its rows."""
    c = chunks(spark, sf_dir)
    one, short = c.select(F.lit("fixed_overlap").alias("strategy"), "chunk_id"), c.where("char_start = 0").select(F.lit("short").alias("strategy"), "chunk_id")
    stale = one.unionByName(one.limit(10).withColumn("strategy", F.lit("short")))
    return stored(stale, ["strategy"], lambda now: now.replace_groups(short, ["strategy"]))


@query(f"WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM papers) AS seen, (SELECT count(*) FROM papers WHERE doc_id % 4 <> 0) AS papers_new, (SELECT count(DISTINCT chunk_id) FROM chunks WHERE doc_id % 4 <> 0) AS chunks_new")
def ingest_stats(spark, sf_dir):
    p, c = papers(spark, sf_dir), chunks(spark, sf_dir)
    a = p.agg(F.count("*").alias("seen"), F.count_if(F.col("doc_id") % 4 != 0).alias("papers_new"))
    return a.crossJoin(c.where(F.col("paper_id").cast("long") % 4 != 0).agg(F.count_distinct("chunk_id").alias("chunks_new")))


@query(f"""WITH {CHUNKS_SQL}, copy AS (SELECT * FROM chunks WHERE doc_id % 11 <> 0)
SELECT c.paper_id, count(*) AS n_source, count(k.chunk_id) AS n_copy, count(*) = count(k.chunk_id) AS complete
FROM chunks c LEFT JOIN (SELECT DISTINCT paper_id, chunk_id, char_start FROM copy) k ON c.paper_id = k.paper_id AND c.chunk_id = k.chunk_id AND c.char_start = k.char_start GROUP BY c.paper_id""")
def restore_check(spark, sf_dir):
    """Rows of a restored copy against the source, document by document."""
    key = ["paper_id", "chunk_id", "char_start"]
    c = chunks(spark, sf_dir).select(*key)
    copy = c.where(F.col("paper_id").cast("long") % 11 != 0).distinct().withColumn("there", F.lit(1))
    out = c.join(copy, key, "left").groupBy("paper_id").agg(F.count("*").alias("n_source"), F.count("there").alias("n_copy"))
    return out.withColumn("complete", F.col("n_source") == F.col("n_copy"))


@query("""SELECT l_orderkey, max(l_shipdate)::DATE AS shipped, arg_max(l_returnflag, {'a': l_shipdate, 'b': l_linenumber, 'c': l_returnflag}) AS flag FROM lineitem GROUP BY l_orderkey""")
def latest_per_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("shipped"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("flag"))


@query("""WITH a AS (SELECT DISTINCT source AS x FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source AS x FROM documents WHERE lang = 'es')
SELECT 'both' AS kind, x FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'first', x FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'any', x FROM (SELECT x FROM a UNION SELECT x FROM b)""")
def corpus_setops(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = (d.where(F.col("lang") == x).select(F.col("source").alias("x")).distinct() for x in ("en", "es"))
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "x")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "first")).unionByName(tag(a.union(b).distinct(), "any"))


@query(f"""WITH {VECTORS_SQL}, q AS (SELECT vec_id AS qid, embedding AS v FROM vectors WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(v, embedding), 6) AS score FROM q, vectors)
SELECT qid, vec_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50""")
def knn_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cosine_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), 50)


@query(f"""WITH {VECTORS_SQL}, q AS (SELECT vec_id AS qid, embedding AS v FROM vectors WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(v, embedding), 6) AS score FROM q, vectors WHERE provider = 'a' AND label < 5)
SELECT qid, vec_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50""")
def knn_filtered(spark, sf_dir):
    """Vectors of another provider are never compared; filters apply before the ranking."""
    v = vectors(spark, sf_dir)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return cosine_topk(v.where("provider = 'a' and label < 5"), q, 50)


@query(f"""WITH {VECTORS_SQL}, q AS (SELECT vec_id AS qid, embedding AS v FROM vectors WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, label, round(list_cosine_similarity(v, embedding), 6) AS score FROM q, vectors)
SELECT qid, vec_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50 AND label = 3""")
def knn_postfilter(spark, sf_dir):
    """Filters apply after the ranking, so fewer than k rows may be left."""
    v = vectors(spark, sf_dir)
    found = knn_cosine(spark, sf_dir)
    return found.join(v.where("label = 3").select(F.col("vec_id").alias("id")), "id", "left_semi").select("qid", "id", "score", "rank")


@query(f"WITH {PAPERS_SQL} SELECT paper_id, sha256(concat(paper_id, text)) AS content_id FROM papers")
def chunk_content_id(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", content_id("paper_id", F.col("text")).alias("content_id"))


@query(f"""WITH {CHUNKS_SQL} SELECT c.chunk_id, p.title, p.published_date FROM (SELECT DISTINCT chunk_id, paper_id FROM chunks) c JOIN papers p ON c.paper_id = p.paper_id""")
def index_upsert(spark, sf_dir):
    """An index that held old titles for some passages, brought up to date; a second run changes nothing."""
    rows = chunks(spark, sf_dir).select("chunk_id", "paper_id").distinct().join(papers(spark, sf_dir).select("paper_id", "title", "published_date"), "paper_id").select("chunk_id", "title", "published_date")
    old = rows.where(F.pmod(F.hash("chunk_id"), F.lit(3)) == 0).withColumn("title", F.lit("old"))
    return stored(old, ["chunk_id"], lambda now: now.upsert(rows, ["chunk_id"]))


@query(f"""WITH {CHUNKS_SQL} SELECT DISTINCT chunk_id, c.paper_id, p.title, CASE WHEN c.doc_id % 2 = 0 THEN 'hashed' END AS index_model, CASE WHEN c.doc_id % 2 = 0 THEN 64 END AS dim, CASE WHEN c.doc_id % 2 = 0 THEN 'hashed' ELSE 'old' END AS noted
FROM chunks c JOIN papers p ON p.paper_id = c.paper_id""")
def reindex_store(spark, sf_dir):
    """Stores of papers and passages rebuilt as an index: half with vectors, noted on the passages, half without."""
    root = scratch_path(spark, "reindex")
    p = store.Store(spark, f"{root}/papers", ["paper_id"], 8).create(papers(spark, sf_dir).select("paper_id", "title"))
    held = chunks(spark, sf_dir).select("chunk_id", "paper_id", "text", F.lit("old").alias("embedding_model"), F.lit(1).alias("embedding_dim")).dropDuplicates(["chunk_id"])
    even, out = F.col("paper_id").cast("long") % 2 == 0, []
    for name, part, embed in (("even", even, hash_embed), ("odd", ~even, None)):
        c = store.Store(spark, f"{root}/{name}", ["chunk_id"], 8).create(held.where(part))
        target = store.Store(spark, f"{root}/{name}-index", ["chunk_id"], 8)
        for _ in range(2):
            reindex(c, p, target, embed, "hashed")
        noted = c.read().select("chunk_id", F.col("embedding_model").alias("noted"))
        index = target.read().select("chunk_id", "paper_id", "title", F.col("embedding_model").alias("index_model"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))
        out.append(index.join(noted, "chunk_id"))
    return out[0].unionByName(out[1])


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value IS NULL OR value >= 300) AS failed FROM events GROUP BY event_type")
def bulk_errors(spark, sf_dir):
    """Results of bulk writes, an event's value read as its status, by the kind of event."""
    return store.bulk_errors(table(spark, sf_dir, "events"), "value", ["event_type"])


DUMPED = ("labels", "benchmark", "conversations", "customer")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, true AS same FROM {t}" for t in DUMPED))
def dump_restore(spark, sf_dir):
    """Tables dumped, restored and compared row by row, repeats included."""
    folder = scratch_path(spark, "dump")
    tables = {t: table(spark, sf_dir, t) for t in DUMPED}
    store.dump(tables, folder)
    out = None
    for name, held in store.restore(spark, folder).items():
        lost = tables[name].exceptAll(held).unionByName(held.exceptAll(tables[name]))
        one = held.agg(F.lit(name).alias("name"), F.count("*").alias("n")).crossJoin(lost.agg((F.count("*") == 0).alias("same")))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT made, category FROM (SELECT DISTINCT unnest([lang, source]) AS category FROM documents WHERE doc_id % 10 <> 0), (SELECT unnest(['first', 'again']) AS made) UNION ALL SELECT 'later', category FROM (SELECT DISTINCT unnest([lang, source]) AS category FROM documents WHERE doc_id % 10 <> 0 AND lang = 'en')")
def categories_cached(spark, sf_dir):
    """Categories of shared papers, made anew after a day: a reader within the day gets what was made first."""
    p, root = papers(spark, sf_dir), scratch_path(spark, "categories")
    narrow = p.where(F.array_contains("category", "en"))
    day, out = 86_400, None
    for made, now, source in (("first", 1e6, p), ("again", 1e6 + day - 1, narrow), ("later", 1e6 + day, narrow)):
        one = store.cached_table(spark, root, day, now, lambda source=source: categories(source)).select(F.lit(made).alias("made"), "category")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT value FROM (SELECT 0 AS k, '' AS s, '# Sources' AS value UNION ALL SELECT 1, '', '' UNION ALL SELECT 2, '', '| source | n |' UNION ALL SELECT 3, '', '|---|---|'
UNION ALL SELECT 4, source, concat('| ', source, ' | ', CAST(count(*) AS VARCHAR), ' |') FROM documents WHERE source IS NOT NULL GROUP BY source)""")
def report_table(spark, sf_dir):
    """A summary written as a Markdown table and read back."""
    n = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return store.markdown_report(n, "Sources", ["source", "n"], scratch_path(spark, "report"))
