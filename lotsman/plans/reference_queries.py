"""Queries of the annotation, evaluation, dataset and batching operators on the test tables, with their SQL.

``embeddings`` serves as segments (vec_id % 5 <> 0; document vec_id div 20) and concepts (vec_id % 5 = 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotsman.functions import text as tx
from lotsman.operators import annotate as an
from lotsman.operators import batching as bt
from lotsman.operators import datasets as ds
from lotsman.operators import metrics as mt
from lotsman.operators import ontology as on
from lotsman.operators import segment as sg
from lotsman.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
T, K, N = 0.1, 3, 20
TRAIN, SEGMENTS = "gisnauka_samples_train", "gisnauka_segments_train_augmented"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- similarity, annotation -------------------------------------------------------------------------------------

def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def segs(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).where("vec_id % 5 <> 0").select(F.expr("vec_id div 20").alias("doc_id"), F.col("vec_id").alias("segment_index"), "embedding")


def comps(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).where("vec_id % 5 = 0").select(F.col("vec_id").alias("comp_id"), "embedding")


def _leaf(id_col: str) -> Column:
    part = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0")
    return F.concat_ws(".", F.lpad(F.col("label").cast("string"), 2, "0"), part(f"{id_col} % 7"), part(f"({id_col} div 5) % 100"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).where("vec_id % 5 = 0").select(F.col("vec_id").alias("comp_id"), _leaf("vec_id").alias("code"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    g = _emb(spark, d).where("vec_id % 5 = 0").select(F.expr("vec_id div 100").alias("hundred"), _leaf("vec_id").alias("code"))
    docs = segs(spark, d).select("doc_id").distinct().withColumn("hundred", F.expr("doc_id div 5"))
    return docs.join(g, "hundred").select("doc_id", "code").distinct()


def _anns(spark: SparkSession, d: str, method: str = "mean_log_count") -> DataFrame:
    return an.annotate(segs(spark, d), comps(spark, d), an.Config(threshold=T, top_k=K, method=method))


_LEAF_SQL = "lpad(label::VARCHAR, 2, '0') || '.' || lpad((vec_id % 7)::VARCHAR, 2, '0') || '.' || lpad(((vec_id // 5) % 100)::VARCHAR, 2, '0')"
PAIRS = f"""
WITH s AS (SELECT vec_id // 20 AS doc_id, vec_id AS segment_index, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 <> 0),
c AS (SELECT vec_id AS comp_id, embedding::DOUBLE[] AS e, {_LEAF_SQL} AS code FROM embeddings WHERE vec_id % 5 = 0),
p AS (SELECT doc_id, segment_index, comp_id, list_inner_product(s.e, c.e) AS score FROM s, c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, comp_id ORDER BY score DESC, segment_index) AS rank FROM p WHERE score >= {T}),
m AS (SELECT * FROM k WHERE rank <= {K}),
gold AS (SELECT DISTINCT a.doc_id, c.code FROM (SELECT DISTINCT doc_id FROM s) a JOIN c ON a.doc_id // 5 = c.comp_id // 100)"""
_AGG = {
    "sum": "sum(score)", "max": "max(score)", "mean": "avg(score)", "median": "median(score)",
    "weighted_mean": "sum(score * greatest(0.2, 1 - 0.2 * (rank - 1))) / sum(greatest(0.2, 1 - 0.2 * (rank - 1)))",
    "sum_log_count": "sum(score) * ln(1 + count(*))", "mean_log_count": "avg(score) * ln(1 + count(*))",
}
ANNS = PAIRS + f", a0 AS (SELECT doc_id, comp_id, {_AGG['mean_log_count']} AS doc_score, sum(score) AS sum_score, avg(score) AS mean_score, count(*) AS segment_count FROM m GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_score DESC, comp_id) AS rank FROM a0)"
PRED = ANNS + f", t0 AS (SELECT doc_id, code, min(rank) AS r FROM a JOIN c USING (comp_id) GROUP BY ALL), pred AS (SELECT * FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS rank FROM t0) WHERE rank <= {N})"


@query(ANNS + " SELECT doc_id, comp_id, rank::INTEGER AS rank, round(doc_score, 6) AS doc_score, round(sum_score, 6) AS sum_score, round(mean_score, 6) AS mean_score, segment_count::INTEGER AS segment_count FROM a")
def annotate_topk(spark, d):
    return _anns(spark, d).select("doc_id", "comp_id", "rank", r6("doc_score").alias("doc_score"), r6("sum_score").alias("sum_score"), r6("mean_score").alias("mean_score"), "segment_count")


for _m in an.METHODS:
    query(PAIRS + f" SELECT doc_id, comp_id, round({_AGG[_m]}, 6) AS doc_score FROM m GROUP BY doc_id, comp_id", f"annotate_agg_{_m}")(lambda spark, d, m=_m: _anns(spark, d, m).select("doc_id", "comp_id", r6("doc_score").alias("doc_score")))


@query(PAIRS + " SELECT doc_id, segment_index, comp_id, rank::INTEGER AS rank, round(score, 6) AS score FROM m")
def top_segments(spark, d):
    return an.top_segments(an.pair_scores(segs(spark, d), comps(spark, d), T), K).select("doc_id", "segment_index", "comp_id", "rank", r6("score").alias("score"))


@query(PRED + " SELECT doc_id, code, rank::INTEGER AS rank FROM pred")
def doc_topk_codes(spark, d):
    return an.top_codes(_anns(spark, d), codes(spark, d), N)


@query(PAIRS + ", b AS (SELECT doc_id, comp_id, max(score) AS score FROM p GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, comp_id) AS rank FROM b) SELECT doc_id, comp_id, rank::INTEGER AS rank, round(score, 6) AS score FROM t WHERE rank <= 20")
def maxpool_topk_codes(spark, d):
    return an.pooled(segs(spark, d), comps(spark, d), N).select("doc_id", "comp_id", "rank", r6("score").alias("score"))


_RAW = "(((segment_index * 31 + comp_id * 17) % 101) / 100.0 * {} - {})"


def _rerank(spark, d, form, raw):
    cfg = an.Config(threshold=T, top_k=K, rerank_top_k=10, method="sum", use_rerank_score=True)
    scorer = lambda pairs: pairs.withColumn("cross_score", form(F.expr(raw)))
    return an.annotate(segs(spark, d), comps(spark, d), cfg, scorer).select("doc_id", "comp_id", r6("doc_score").alias("doc_score"), "segment_count")


def _rerank_sql(form: str) -> str:
    return PAIRS + f""", f AS (SELECT doc_id, comp_id, sum(score) AS s, count(*) AS n FROM k WHERE rank <= 50 GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, comp_id) AS ar FROM f),
x AS (SELECT k.doc_id, k.comp_id, k.segment_index, {form} AS cs FROM k JOIN fr USING (doc_id, comp_id) WHERE k.rank <= 50 AND ar <= 10),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, comp_id ORDER BY cs DESC, segment_index) AS cr FROM x WHERE cs >= {T}),
z AS (SELECT doc_id, comp_id, sum(cs) AS s FROM y WHERE cr <= {K} GROUP BY ALL)
SELECT doc_id, comp_id, round(z.s, 6) AS doc_score, n::INTEGER AS segment_count FROM z JOIN fr USING (doc_id, comp_id)
UNION ALL SELECT doc_id, comp_id, round(s, 6), n::INTEGER FROM fr WHERE ar > 10"""


@query(_rerank_sql(f"1 / (1 + exp(-{_RAW.format(20, 10)} / 5))"))
def rerank_sigmoid(spark, d):
    return _rerank(spark, d, an.sigmoid, _RAW.format(20, 10).replace("100.0", "100.0D"))


@query(_rerank_sql(f"greatest(0.0, least(1.0, {_RAW.format(2, 0.5)}))"))
def rerank_clip(spark, d):
    return _rerank(spark, d, an.clipped, _RAW.format(2, "0.5D").replace("100.0", "100.0D"))


def _rollup(level: int) -> str:
    cut = "regexp_extract(code, '^[0-9]+\\.[0-9]+')" if level == 2 else "regexp_extract(code, '^[0-9]+')"
    return ANNS + f" SELECT doc_id, {cut} AS code, round(sum(doc_score), 6) AS doc_score, sum(segment_count)::BIGINT AS segment_count FROM a JOIN c USING (comp_id) WHERE rank <= 20 GROUP BY 1, 2"


for _name, _level in (("rollup_parent", 2), ("rollup_grand", 1)):
    query(_rollup(_level), _name)(lambda spark, d, level=_level: an.rolled_up(_anns(spark, d), codes(spark, d), level, N).withColumn("doc_score", r6("doc_score")))

# ---- metrics ----------------------------------------------------------------------------------------------------

_PER = """
, lv AS (SELECT unnest([1, 2, 3]) AS level),
pl AS (SELECT doc_id, level, code, row_number() OVER (PARTITION BY doc_id, level ORDER BY r) AS rank FROM (SELECT doc_id, level, array_to_string(string_split(code, '.')[1:level], '.') AS code, min(rank) AS r FROM pred, lv GROUP BY ALL)),
gl AS (SELECT DISTINCT doc_id, level, array_to_string(string_split(code, '.')[1:level], '.') AS code FROM gold, lv),
docs AS (SELECT DISTINCT doc_id FROM s),
np AS (SELECT doc_id, level, count(*) AS n_pred FROM pl GROUP BY ALL), ng AS (SELECT doc_id, level, count(*) AS n_gold FROM gl GROUP BY ALL),
h AS (SELECT pl.doc_id, pl.level, pl.rank, row_number() OVER (PARTITION BY pl.doc_id, pl.level ORDER BY pl.rank) AS so_far FROM pl JOIN gl USING (doc_id, level, code)),
base AS (SELECT doc_id, level, {k} AS k, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM docs CROSS JOIN lv LEFT JOIN np USING (doc_id, level) LEFT JOIN ng USING (doc_id, level)),
q AS (SELECT base.*, count(h.rank) AS hits, min(h.rank) AS first, sum(h.so_far / h.rank) AS ap FROM base LEFT JOIN h ON h.doc_id = base.doc_id AND h.level = base.level AND h.rank <= k GROUP BY ALL),
per AS (SELECT doc_id, level, k, CASE WHEN k <= 0 THEN 0 WHEN n_gold = 0 THEN 1 ELSE hits / n_gold END AS recall, CASE WHEN k <= 0 OR n_pred = 0 THEN 0 ELSE hits / least(k, n_pred) END AS precision,
 CASE WHEN k <= 0 THEN 0 WHEN n_gold = 0 THEN 1 ELSE coalesce(1 / first, 0) END AS mrr, CASE WHEN k <= 0 THEN 0 WHEN n_gold = 0 THEN 1 ELSE coalesce(ap, 0) / n_gold END AS ap FROM q)"""
_KS = _PER.replace("{k}", "unnest([1, 5, 10, 20])")
_VALUES = "round({0}recall{1}, 6) AS recall, round({0}precision{1}, 6) AS precision, round({0}mrr{1}, 6) AS mrr, round({0}ap{1}, 6) AS ap"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("recall", "precision", "mrr", "ap")})


def _pred(spark, d):
    return an.top_codes(_anns(spark, d), codes(spark, d), N)


@query(PRED + _KS + " SELECT level, k, " + _VALUES.format("avg(", ")") + " FROM per GROUP BY level, k")
def metrics_by_level_k(spark, d):
    return _rounded(mt.evaluation(_pred(spark, d), gold(spark, d), segs(spark, d).select("doc_id").distinct(), (1, 5, 10, 20)))


@query(PRED + _PER.replace("{k}", "coalesce(n_gold, 0)") + " SELECT doc_id, k::BIGINT AS k, " + _VALUES.format("", "") + " FROM per WHERE level = 3")
def metrics_at_m(spark, d):
    return _rounded(mt.per_document(_pred(spark, d), gold(spark, d), segs(spark, d), None))


@query(PRED + _KS + " SELECT k, " + _VALUES.format("avg(", ")") + " FROM per WHERE level = 3 GROUP BY k")
def metrics_macro(spark, d):
    return _rounded(mt.macro(mt.per_document(_pred(spark, d), gold(spark, d), segs(spark, d), (1, 5, 10, 20)), "k"))


@query(PRED + ", g AS (SELECT doc_id, count(*) AS g FROM gold GROUP BY ALL), p2 AS (SELECT doc_id, count(*) AS p FROM pred GROUP BY ALL) SELECT count(*) AS docs_total, count(*) FILTER (x.doc_id % 7 = 0) AS missing_text, count(*) FILTER (p IS NULL) AS no_pred, round(avg(coalesce(g, 0)), 6) AS avg_gold, round(avg(coalesce(p, 0)), 6) AS avg_pred FROM (SELECT DISTINCT doc_id FROM s) x LEFT JOIN g USING (doc_id) LEFT JOIN p2 USING (doc_id)")
def report_stats(spark, d):
    docs = segs(spark, d).select("doc_id").distinct().withColumn("text", F.when(F.expr("doc_id % 7 <> 0"), "x"))
    return mt.report_stats(docs, _pred(spark, d), gold(spark, d)).withColumns({"avg_gold": r6("avg_gold"), "avg_pred": r6("avg_pred")})

# ---- ontology ---------------------------------------------------------------------------------------------------

_LINKS = """
WITH links AS (SELECT 0 AS o, r_regionkey::BIGINT AS k, 'root' AS source, 'r' || r_regionkey AS target FROM region
UNION ALL SELECT 1, n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 2, n_nationkey, 'r' || ((n_regionkey + 1) % 5), 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT 3, s_suppkey, 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION ALL SELECT 4, n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey = 3)"""
_NODES = ", nodes AS (SELECT 'root' AS id, 'Все' AS label UNION ALL SELECT 'r' || r_regionkey, '0' || r_regionkey || ' ' || r_name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'Supplier ' || s_suppkey FROM supplier)"


def links(spark, d):
    nation, key = table(spark, d, "nation"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, o, k, s, t: df.select((F.lit(o) * 10**12 + F.col(k)).cast("bigint").alias("link_ord"), s.alias("source"), t.alias("target"))
    out = row(table(spark, d, "region"), 0, "r_regionkey", F.lit("root"), key("r", "r_regionkey"))
    out = out.unionByName(row(nation, 1, "n_nationkey", key("r", "n_regionkey"), key("n", "n_nationkey")))
    out = out.unionByName(row(nation.where("n_nationkey % 6 = 0"), 2, "n_nationkey", F.expr("concat('r', (n_regionkey + 1) % 5)"), key("n", "n_nationkey")))
    out = out.unionByName(row(table(spark, d, "supplier"), 3, "s_suppkey", key("n", "s_nationkey"), key("s", "s_suppkey")))
    return out.unionByName(row(nation.where("n_nationkey = 3"), 4, "n_nationkey", key("n", "n_nationkey"), key("r", "n_regionkey")))


def nodes(spark, d):
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit("Все").alias("label"))
    out = root.unionByName(table(spark, d, "region").select(F.expr("concat('r', r_regionkey)").alias("id"), F.expr("concat('0', r_regionkey, ' ', r_name)").alias("label")))
    out = out.unionByName(table(spark, d, "nation").select(F.expr("concat('n', n_nationkey)").alias("id"), F.col("n_name").alias("label")))
    return out.unionByName(table(spark, d, "supplier").select(F.expr("concat('s', s_suppkey)").alias("id"), F.expr("concat('Supplier ', s_suppkey)").alias("label")))


@query(_LINKS.replace("WITH links", "WITH RECURSIVE links") + ", r AS (SELECT 'root' AS root, 'root' AS id UNION SELECT 'r1', 'r1' UNION SELECT root, target FROM r JOIN links ON id = source) SELECT root, id FROM r")
def tree_descendants(spark, d):
    return on.descendants(links(spark, d), spark.createDataFrame([("root",), ("r1",)], "root string"))


@query(_LINKS + _NODES + " SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM links)")
def tree_leaves(spark, d):
    return on.leaves(nodes(spark, d), links(spark, d)).select("id")


@query(_LINKS + " SELECT target AS id, min_by(source, o * 1000000000000 + k) AS parent FROM links GROUP BY target")
def tree_parent_first(spark, d):
    return on.first_parents(links(spark, d))


@query(_LINKS + " SELECT source AS id, array_to_string(list(target ORDER BY o, k), ';') AS children FROM links GROUP BY source")
def tree_children(spark, d):
    return on.children(links(spark, d)).withColumn("children", F.array_join("children", ";"))


@query(_LINKS + _NODES + """, par AS (SELECT target AS id, min_by(source, o * 1000000000000 + k) AS p FROM links WHERE target <> 'root' GROUP BY target),
t AS (SELECT id, CASE WHEN regexp_matches(label, '^[0-9]{2} ') THEN substr(label, 4) ELSE label END AS title FROM nodes)
SELECT t.id, CASE WHEN g.p IS NOT NULL AND g.p <> 'root' THEN 'Раздел: ' || gt.title || '. ' ELSE '' END || CASE WHEN par.p IS NOT NULL AND par.p <> 'root' THEN 'Область: ' || pt.title || '. ' ELSE '' END || t.title AS full_label
FROM t LEFT JOIN par ON par.id = t.id LEFT JOIN par g ON g.id = par.p LEFT JOIN t pt ON pt.id = par.p LEFT JOIN t gt ON gt.id = g.p""")
def tree_full_label(spark, d):
    return on.full_labels(nodes(spark, d), on.first_parents(links(spark, d), "root"), "root")


_NODE_TABLE = "WITH n AS (SELECT node_ord, id, trim(coalesce(code, '')) AS code, nullif(trim(coalesce(label, '')), '') AS label, nullif(trim(coalesce(full_label, '')), '') AS full_label, nullif(trim(coalesce(llm_description, '')), '') AS descr FROM grnti_nodes)"


@query(_NODE_TABLE + " SELECT id, code FROM n WHERE code <> ''")
def ontology_codes(spark, d):
    return on.code_map(table(spark, d, "grnti_nodes"))


@query(_NODE_TABLE + " SELECT code, max_by(coalesce(nullif(trim(concat_ws('. ', coalesce(full_label, label), descr), ' .'), ''), code), node_ord) AS text FROM n WHERE code <> '' GROUP BY code")
def ontology_texts(spark, d):
    return on.texts(table(spark, d, "grnti_nodes"))


@query(_NODE_TABLE + " SELECT id, trim(concat_ws('. ', full_label, descr), '. ') AS text FROM n WHERE trim(concat_ws('. ', full_label, descr), '. ') <> ''")
def ontology_embedding_texts(spark, d):
    return on.embedding_texts(table(spark, d, "grnti_nodes"))


@query("SELECT trim(code) AS code, min_by(label, node_ord) AS label FROM grnti_nodes WHERE regexp_full_match(trim(code), '[0-9]{2}') GROUP BY 1")
def ontology_top_levels(spark, d):
    return on.top_levels(table(spark, d, "grnti_nodes"))

# ---- codes, text ------------------------------------------------------------------------------------------------

_CODES = "(SELECT row_id, leaf AS c FROM row_meta)"


@query(f"SELECT row_id, regexp_full_match(coalesce(c, ''), '[0-9]+\\.[0-9]+\\.[0-9]+') AS leaf, CASE WHEN regexp_matches(c, '^[0-9]+\\.[0-9]+(\\.|$)') THEN regexp_extract(c, '^[0-9]+\\.[0-9]+') END AS level2, CASE WHEN regexp_matches(c, '^[0-9]+(\\.|$)') THEN regexp_extract(c, '^[0-9]+') END AS level1 FROM {_CODES}")
def code_levels(spark, d):
    return table(spark, d, "row_meta").select("row_id", tx.is_leaf("leaf").alias("leaf"), tx.to_level("leaf", 2).alias("level2"), tx.to_level("leaf", 1).alias("level1"))


@query("SELECT row_id, array_to_string(list_filter(list_transform(string_split(coalesce(doc_gold_leaves, ''), ';'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+\\.[0-9]+\\.[0-9]+')), ';') AS codes FROM row_meta")
def code_parse(spark, d):
    return table(spark, d, "row_meta").select("row_id", F.array_join(tx.code_list("doc_gold_leaves"), ";").alias("codes"))


@query("WITH t AS (SELECT row_id, regexp_extract(coalesce(text2, ''), '^([0-9]{2}(?:\\.[0-9]{2}){0,2})', 1) AS code, coalesce(text2, '') AS t FROM row_meta) SELECT row_id, nullif(code, '') AS code, CASE WHEN code = '' THEN t WHEN trim(substr(t, length(code) + 1), ' :–-') = '' THEN code ELSE trim(substr(t, length(code) + 1), ' :–-') END AS title FROM t")
def label_parse(spark, d):
    return table(spark, d, "row_meta").select("row_id", tx.label_code("text2").alias("code"), tx.label_title("text2").alias("title"))


_SQUEEZE = "regexp_replace(regexp_replace(segment_text, '[\\s\\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')".replace("{{", "{").replace("}}", "}")


@query(f"SELECT row_id, length({_SQUEEZE}) AS n_chars FROM {SEGMENTS} WHERE length({_SQUEEZE}) BETWEEN 60 AND 600")
def seg_length_band(spark, d):
    return table(spark, d, SEGMENTS).withColumn("n_chars", F.length(tx.squeeze("segment_text"))).where("n_chars between 60 and 600").select("row_id", "n_chars")


_TRIM = "regexp_replace(coalesce(segment_text, ''), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')"


@query(f"""WITH t AS (SELECT row_id, {_TRIM} AS s FROM {SEGMENTS})
SELECT row_id, (length(s) < 15 OR regexp_replace(lower(s), ':+$', '') = 'техническое задание' OR regexp_full_match(lower(s), 'раздел\\s+[0-9]+\\.?\\s*') OR regexp_full_match(lower(s), 'раздел\\s+[0-9]+\\.?\\s+[а-яё\\s]+')
 OR regexp_full_match(s, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2,4}}') OR regexp_full_match(s, '[А-ЯЁ][а-яё\\s]+,\\s*г\\.\\s*[А-ЯЁ][а-яё]+\\s+[0-9]{{4}}') OR regexp_full_match(s, '[А-ЯЁ][а-яё]+\\s+[0-9]{{4}}') OR regexp_full_match(s, '[0-9\\s.,\\-:]+')) AS dropped FROM t""")
def seg_filter(spark, d):
    return table(spark, d, SEGMENTS).select("row_id", tx.uninformative("segment_text").alias("dropped"))


@query(f"SELECT row_id, doc_id FROM {SEGMENTS} WHERE doc_id IN (SELECT doc_id FROM {SEGMENTS} GROUP BY doc_id HAVING count(*) < 14)")
def doc_segment_cap(spark, d):
    return ds.capped_documents(table(spark, d, SEGMENTS)).select("row_id", "doc_id")


@query(f"""WITH o AS (SELECT row_id, segment_text AS t, lag(segment_text) OVER w AS p, lead(segment_text) OVER w AS n FROM (SELECT row_id, segment_text, CASE WHEN regexp_full_match(coalesce(doc_id, ''), '[\\s\\x{{00A0}}]*') THEN 'row ' || row_id ELSE doc_id END AS d FROM {SEGMENTS}) WINDOW w AS (PARTITION BY d ORDER BY row_id))
SELECT row_id, CASE WHEN length(t) > 100 THEN t ELSE concat_ws('  ', CASE WHEN length(p) > 200 THEN left(p, 200) || '...' ELSE p END, t, t, CASE WHEN length(n) > 200 THEN left(n, 200) || '...' ELSE n END) END AS context_text FROM o""")
def context_window(spark, d):
    """All segments; a row without doc_id has no neighbours."""
    doc = F.when(tx.missing("doc_id").isNull(), F.concat(F.lit("row "), F.col("row_id"))).otherwise(F.col("doc_id"))
    rows = table(spark, d, SEGMENTS).select("row_id", doc.alias("doc_id"), F.col("row_id").alias("segment_index"), "segment_text")
    return an.with_context(rows, 100).select("row_id", "context_text")


@query()
def segment_text(spark, d):
    return sg.segments(table(spark, d, "documents"))


@query()
def segment_informative(spark, d):
    return sg.informative(sg.segments(table(spark, d, "documents")))

# ---- datasets ---------------------------------------------------------------------------------------------------

_STATS = "SELECT count(*) AS n, min({0}) AS min, max({0}) AS max, round(avg({0}), 6) AS mean, median({0}) AS median, (list({0} ORDER BY {0}))[floor(0.9::DOUBLE * count(*) - 0.9::DOUBLE)::BIGINT + 1] AS p90, (list({0} ORDER BY {0}))[floor(0.95::DOUBLE * count(*) - 0.95::DOUBLE)::BIGINT + 1] AS p95, (list({0} ORDER BY {0}))[floor(0.99::DOUBLE * count(*) - 0.99::DOUBLE)::BIGINT + 1] AS p99 FROM {1}"


@query(_STATS.format("x", "(SELECT length(text) AS x FROM documents WHERE text IS NOT NULL)"))
def length_stats(spark, d):
    return ds.statistics(table(spark, d, "documents").select(F.length("text").alias("x")), "x").withColumn("mean", r6("mean"))


@query(_STATS.format("x", f"(SELECT count(*) AS x FROM {SEGMENTS} GROUP BY doc_id)"))
def segments_per_doc_stats(spark, d):
    return ds.statistics(table(spark, d, SEGMENTS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("x")), "x").withColumn("mean", r6("mean"))


@query(f"SELECT row_id, length(segment_text) AS n_chars FROM {SEGMENTS} WHERE segment_text IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 1")
def longest_segment(spark, d):
    return ds.longest(table(spark, d, SEGMENTS), "segment_text", "row_id")


def _keys(t: str) -> str:
    trim = "lower(regexp_replace(coalesce({}, ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))"
    return f"SELECT row_id, {trim.format('title')} AS kt, {trim.format('abstract')} AS ka FROM {t}"


@query(f"WITH a AS ({_keys(TRAIN)}), b AS ({_keys('gisnauka_samples_test')}) SELECT kt, ka FROM a WHERE kt <> '' OR ka <> '' INTERSECT SELECT kt, ka FROM b")
def split_overlap(spark, d):
    return ds.common_keys(table(spark, d, TRAIN), table(spark, d, "gisnauka_samples_test"))


@query(f"WITH a AS ({_keys(TRAIN)}), b AS ({_keys('gisnauka_samples_test')}) SELECT row_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kt = a.kt AND b.ka = a.ka AND (b.kt <> '' OR b.ka <> ''))")
def anti_dedup(spark, d):
    return ds.without_keys_of(table(spark, d, TRAIN), table(spark, d, "gisnauka_samples_test")).select("row_id")


_WS = "regexp_replace(coalesce({}, ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


@query(f"""WITH g AS (SELECT row_id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(grnti_codes, ''), ';'), lambda x: {_WS.format('x')}), lambda x: regexp_full_match(x, '[0-9]+\\.[0-9]+\\.[0-9]+')))) AS c,
{_WS.format('doc_id')} AS doc, {_WS.format('top_code')} AS top, {_WS.format(_WS.format('title') + " || chr(10) || chr(10) || " + _WS.format('abstract'))} AS text FROM {TRAIN})
SELECT row_id AS row_ord, CASE WHEN doc = '' THEN 'gisnauka_' || row_id ELSE doc END AS doc_id, array_to_string(c, ';') AS gold_codes, text, CASE WHEN top = '' THEN regexp_extract(c[1], '^[0-9]+') ELSE top END AS top_code FROM g WHERE len(c) > 0 AND text <> ''""")
def gold_scan(spark, d):
    return ds.gold_items(table(spark, d, TRAIN)).withColumn("gold_codes", F.array_join("gold_codes", ";"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_first_per_top(spark, d):
    return ds.first_per_class(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


def _split_sql(share: str, a: str, b: str) -> str:
    return f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42~' || doc_id), doc_id) <= (SELECT greatest(1, round_even(count(*) * {share}, 0)) FROM documents) THEN '{a}' ELSE '{b}' END AS split FROM documents"


@query(_split_sql("0.1", "valid", "train"))
def split_valid_10pct(spark, d):
    return ds.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", (1, 10), ("valid", "train"))


@query(_split_sql("1.0 / 3", "test", "valid"))
def split_third(spark, d):
    return ds.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", (1, 3), ("test", "valid"))


_BALANCE = """WITH k AS (SELECT min(n) AS k FROM (SELECT count(DISTINCT p_brand) AS n FROM part GROUP BY p_type)),
a AS (SELECT *, md5('42~' || p_partkey) AS o FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY o, p_partkey) AS c FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY (c > 1)::INTEGER, o, p_partkey) AS r FROM b)"""


@query(_BALANCE + " SELECT p_partkey, p_type, p_brand FROM r WHERE r <= (SELECT k FROM k)")
def balanced_pairs(spark, d):
    return ds.balanced(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_type", "p_brand", "p_partkey")


@query("WITH g AS (SELECT p_type, count(*) AS n_rows, count(DISTINCT p_brand) AS n_codes FROM part GROUP BY 1) SELECT p_type, n_rows, n_codes, n_rows - n_codes AS repeats, round(n_rows / (SELECT sum(n_rows) FROM g), 6) AS fraction FROM g")
def class_distribution(spark, d):
    return ds.distribution(table(spark, d, "part"), "p_type", "p_brand").withColumn("fraction", r6("fraction"))


_COUNTS = "WITH n AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1), q AS (SELECT event_type, cnt, (SELECT max(cnt) FROM n) - cnt AS need FROM n)"


@query(_COUNTS + " SELECT event_type AS code, cnt, need FROM q WHERE need > 0")
def class_deficit(spark, d):
    return ds.deficits(table(spark, d, "events").groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("cnt")))


@query(_COUNTS + " SELECT event_id, event_type FROM (SELECT e.event_id, e.event_type, need, row_number() OVER (PARTITION BY e.event_type ORDER BY ts, event_id) AS r FROM events e JOIN q USING (event_type) WHERE need > 0) WHERE r <= need")
def quota_fill(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    need = ds.deficits(e.groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))).select(F.col("code").alias("event_type"), "need")
    return ds.quota_fill(e, need, "event_type", ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 10")
def page_collect(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return ds.quota_fill(e, e.select("event_type").distinct().withColumn("need", F.lit(10)), "event_type", ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT code, count(*) AS cnt FROM (SELECT unnest(string_split(doc_gold_leaves, ';')) AS code FROM row_meta) WHERE regexp_full_match(code, '[0-9]+\\.[0-9]+\\.[0-9]+') GROUP BY code")
def code_counts(spark, d):
    return ds.code_counts(table(spark, d, "row_meta").select(F.col("doc_gold_leaves").alias("grnti_codes")))


@query()
def neg_sampling(spark, d):
    """Every document is a query; relevant to it are the documents of its text, itself among them."""
    text = F.when(tx.missing("text").isNotNull(), F.md5("text")).otherwise(F.concat(F.lit("document "), F.col("doc_id")))
    docs = table(spark, d, "documents").select("doc_id", text.alias("same"))
    rel = docs.select(F.col("doc_id").alias("query_id"), "same").join(docs, "same").select("query_id", "doc_id")
    return ds.negatives(docs.select(F.col("doc_id").alias("query_id")), docs.select("doc_id"), rel)

# ---- batches ----------------------------------------------------------------------------------------------------

def hier(spark, d):
    e = _emb(spark, d).select("vec_id", F.expr("vec_id div 20").alias("doc_id"), _leaf("vec_id").alias("leaf"))
    g = e.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("leaf")), ";").alias("gold"))
    return e.join(g, "doc_id").select(F.col("vec_id").alias("row_id"), "doc_id", "leaf", tx.parent_of("leaf").alias("parent"), tx.grand_of("leaf").alias("grand"), "gold")


_HIER = f"WITH e AS (SELECT vec_id AS row_id, vec_id // 20 AS doc_id, {_LEAF_SQL} AS leaf FROM embeddings), g AS (SELECT doc_id, list(DISTINCT leaf) AS gold FROM e GROUP BY doc_id), h AS (SELECT row_id, doc_id, leaf, regexp_extract(leaf, '^[0-9]+\\.[0-9]+') AS parent, regexp_extract(leaf, '^[0-9]+') AS grand, gold, (row_id * 7919 % 1000003) // 16 % 100000 AS b0, row_id // 16 AS batch FROM e JOIN g USING (doc_id))"


@query(_HIER + ", l AS (SELECT leaf, count(*) AS n FROM h GROUP BY 1), r AS (SELECT grand, count(*) AS n FROM h GROUP BY 1) SELECT row_id, round(((SELECT max(n) FROM l) / l.n) ** 0.5 * ((SELECT max(n) FROM r) / r.n), 6) AS weight FROM h JOIN l USING (leaf) JOIN r USING (grand)")
def sampling_weights(spark, d):
    return bt.sampling_weights(hier(spark, d)).select("row_id", r6("weight").alias("weight"))


@query(_HIER + ", x AS (SELECT doc_id, leaf FROM h) SELECT row_id, doc_id, leaf, parent, grand, array_to_string(list_sort(gold), ';') AS doc_gold_leaves FROM h")
def hier_rows(spark, d):
    e = _emb(spark, d).select("vec_id", F.expr("vec_id div 20").alias("doc_id"), F.array(_leaf("vec_id")).alias("codes"))
    segments = e.select("doc_id", F.col("vec_id").alias("segment_index"), F.col("vec_id").cast("string").alias("segment_text"), "codes")
    texts = e.select(F.col("codes")[0].alias("code")).distinct().withColumn("text", F.concat(F.lit("text of "), F.col("code")))
    return bt.hierarchical_rows(segments, texts).select(F.col("segment_index").alias("row_id"), "doc_id", "leaf", "parent", "grand", "doc_gold_leaves")


def batched(spark, d):
    return hier(spark, d).withColumn("batch", F.expr("row_id div 16")).withColumn("pos", F.col("row_id")).withColumn("gold", F.split("gold", ";"))


_REL = ", e2 AS (SELECT a.batch, a.row_id AS a, b.row_id AS b, CASE WHEN a.leaf = b.leaf THEN 'dup' WHEN a.grand <> b.grand THEN 'far' WHEN a.parent <> b.parent THEN 'mid' ELSE 'hard' END AS rel, list_contains(a.gold, b.leaf) AS bad FROM h a JOIN h b ON a.batch = b.batch AND a.row_id <> b.row_id)"


@query(_HIER + _REL + " SELECT batch, a, b, rel FROM e2")
def relation_edges(spark, d):
    return bt.batch_pairs(batched(spark, d)).select("batch", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), bt.relation("a", "b").alias("rel"))


@query(_HIER + _REL + " SELECT batch, " + ", ".join(f"round(count(*) FILTER (rel = '{k}') / count(*), 6) AS {k}" for k in ("far", "mid", "hard")) + " FROM e2 WHERE rel <> 'dup' GROUP BY batch")
def batch_mix(spark, d):
    return bt.batch_mix(batched(spark, d)).select("batch", *[r6(k).alias(k) for k in ("far", "mid", "hard")])


@query(_HIER + " SELECT batch, count(*) AS size, count(*) - count(DISTINCT doc_id) AS dup_docs, count(*) - count(DISTINCT leaf) AS dup_leaves FROM h GROUP BY batch")
def batch_violations(spark, d):
    return bt.batch_violations(batched(spark, d))


@query(_HIER + _REL + ", f AS (SELECT batch, count(*) FILTER (bad) AS bad FROM e2 GROUP BY 1), z AS (SELECT batch, count(*) AS size FROM h GROUP BY 1) SELECT batch, size, round(CASE WHEN size > 1 THEN bad / (size * (size - 1)) ELSE 0 END, 6) AS fraction FROM z LEFT JOIN f USING (batch) WHERE size <= 1 OR bad / (size * (size - 1)) <= 0.75")
def fn_pair_filter(spark, d):
    return bt.kept_batches(bt.false_negatives(batched(spark, d)), 0.75).withColumn("fraction", r6("fraction"))


@query(f"""WITH e AS (SELECT vec_id AS pos, vec_id // 100 AS batch, lpad(label::VARCHAR, 2, '0') AS leaf, (label % 2) AS grand, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.*, b.v AS w FROM e a JOIN e b ON b.pos = a.pos + 1)
SELECT a.batch, a.pos AS a, b.pos AS b FROM p a JOIN p b ON a.batch = b.batch AND a.pos <> b.pos AND a.leaf <> b.leaf AND a.grand = b.grand WHERE list_inner_product(a.v, b.w) >= list_inner_product(a.v, a.w) * 0.9""")
def safe_hard(spark, d):
    e = _emb(spark, d).select(F.col("vec_id").alias("pos"), F.expr("vec_id div 100").alias("batch"), F.lpad(F.col("label").cast("string"), 2, "0").alias("leaf"), (F.col("label") % 2).alias("grand"), (F.col("label") % 2).alias("parent"), F.col("embedding").alias("seg_vec"))
    nxt = _emb(spark, d).select((F.col("vec_id") - 1).alias("pos"), F.col("embedding").alias("pos_vec"))
    return bt.unsafe_siblings(e.join(nxt, "pos"), 0.1)


@query()
def batch_plan(spark, d):
    return bt.batch_plan(bt.sampling_weights(hier(spark, d)), 3)


@query()
def unique_batches(spark, d):
    return bt.unique_batches(hier(spark, d).withColumn("segment", F.col("row_id")), 16)

# ---- repair of JSON lines ---------------------------------------------------------------------------------------

@query("""SELECT event_id, '{"id":' || event_id || ',"codes":["1.2.3"],"evidence":{"kind":"' || event_type || '"}}' AS repaired FROM events""")
def json_repair(spark, d):
    """Each line has a comma in a key's quotes, one before a bracket and one at its end."""
    broken = F.format_string('{"id":%d,"codes":["1.2.3", ],",evidence": {"kind":"%s",},}, ', "event_id", "event_type")
    return table(spark, d, "events").select("event_id", F.replace(tx.repaired_json(broken), F.lit('"evidence": '), F.lit('"evidence":')).alias("repaired"))
