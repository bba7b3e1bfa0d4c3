"""The query catalogue: each entry runs an operator over whole tables; SQL says the same where SQL can.

Fact-shaped inputs are the stored tables themselves. ``store`` is the fact store after keyed writes (last delivery per id), ``edges`` the
relationship store per directed pair, ``ch`` the distinct chunks, ``blocks``, ``words`` and ``images`` the page views of the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import interfaces
from factloom.functions import similarity, units
from factloom.operators import compare, detection, extraction, graph, knn, layout, matching, pipeline, store
from factloom.sources import pages
from factloom.sources.tables import table
from factloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SCOPE_KEYS = ("period", "type", "quarter", "fiscal_year", "year", "segment")
_PARTS = ", ".join(f"""CASE WHEN s_{k} IS NOT NULL THEN '"{k}":"' || s_{k} || '"' END""" for k in SCOPE_KEYS)
CTES = {
    "store": "store AS (SELECT * FROM facts WHERE fact_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY ingest_seq DESC) = 1)",
    "ch": "ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)",
    "edges": "edges AS (SELECT fact_id_a, fact_id_b, e.relationship_type AS relationship_type, e.confidence AS confidence, e.justification AS justification, e.created_at AS created_at FROM (SELECT fact_id_a, fact_id_b, max(struct_pack(a := coalesce(created_at, '-infinity'::DOUBLE), b := coalesce(relationship_type, ''), c := coalesce(confidence, 0), d := coalesce(justification, ''))) AS k, max_by(struct_pack(relationship_type := relationship_type, confidence := confidence, justification := justification, created_at := created_at), struct_pack(a := coalesce(created_at, '-infinity'::DOUBLE), b := coalesce(relationship_type, ''), c := coalesce(confidence, 0), d := coalesce(justification, ''))) AS e FROM relationships WHERE fact_id_a IS NOT NULL AND fact_id_b IS NOT NULL GROUP BY ALL))",
    "scoped": f"js AS (SELECT *, CASE WHEN json_valid(data_json) THEN data_json END AS j FROM store), sk AS (SELECT *, {', '.join(f'''json_extract_string(j, '$.temporal_scope.{k}') AS s_{k}''' for k in SCOPE_KEYS)} FROM js), scoped AS (SELECT * EXCLUDE (j), '{{' || concat_ws(',', {_PARTS}) || '}}' AS scope FROM sk)",
    "blocks": "blocks AS (SELECT chunk_id, document_id, page_number, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order_index, chunk_id) - 1)::INT AS block_no, CASE WHEN chunk_type = 'chart_candidate' THEN 1 ELSE 0 END AS block_type, bbox.x0 * 612 AS x0, bbox.y0 * 792 AS y0, bbox.x1 * 612 AS x1, bbox.y1 * 792 AS y1, text, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height FROM ch)",
    "norm": "norm AS (SELECT * REPLACE (x0 / page_width AS x0, x1 / page_width AS x1, y0 / page_height AS y0, y1 / page_height AS y1) FROM blocks WHERE page_width > 0 AND page_height > 0)",
    "texts": r"texts AS (SELECT * FROM norm WHERE block_type = 0 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')",
    "bands": "mids AS (SELECT document_id, page_number, (y0 + y1) / 2 AS y FROM norm WHERE block_type = 0), st AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY document_id ORDER BY y) > 0.02 THEN 1 WHEN lag(y) OVER (PARTITION BY document_id ORDER BY y) IS NULL THEN 1 ELSE 0 END AS new FROM mids), cl AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS c FROM st), ce AS (SELECT document_id, round(avg(y), 6) AS centre FROM cl GROUP BY document_id, c HAVING round(avg(y), 6) < 0.15 OR round(avg(y), 6) > 0.85), np AS (SELECT document_id, count(DISTINCT page_number) AS n_pages FROM norm GROUP BY 1 HAVING count(DISTINCT page_number) >= 2), hi AS (SELECT ce.document_id, centre, count(DISTINCT page_number) AS hits FROM ce JOIN mids ON ce.document_id = mids.document_id AND abs(y - centre) <= 0.02 + 1e-9 GROUP BY 1, 2), bands AS (SELECT hi.document_id, round(centre - 0.02, 6) AS lo, round(centre + 0.02, 6) AS hi, CASE WHEN centre < 0.15 THEN 'header' ELSE 'footer' END AS kind, hits FROM hi JOIN np ON hi.document_id = np.document_id WHERE hits >= 2 AND hits >= 0.5 * n_pages)",
    "words": "wc AS (SELECT chunk_id, document_id, page_number, bbox, r.i AS r, r.row AS cells FROM ch, unnest(list_transform(table_data, lambda x, i: struct_pack(i := i - 1, row := x))) u(r) WHERE table_data IS NOT NULL), wd AS (SELECT wc.*, c.i AS c, c.t AS text FROM wc, unnest(list_transform(cells, lambda x, i: struct_pack(i := i - 1, t := x))) v(c) WHERE cells IS NOT NULL), words AS (SELECT document_id, page_number, concat_ws('-', chunk_id, r, c) AS word_no, (floor(bbox.x0 * 100) * 2 + c * 90)::DOUBLE AS x0, (floor(bbox.x0 * 100) * 2 + c * 90 + least(length(text) * 5, 80))::DOUBLE AS x1, (floor(bbox.y0 * 100) * 5 + r * 14)::DOUBLE AS top, (floor(bbox.y0 * 100) * 5 + r * 14 + 11)::DOUBLE AS bottom, text, 612.0 AS page_width FROM wd WHERE text IS NOT NULL AND text <> '')",
    "lines": "ln AS (SELECT *, round_even((top + bottom) / 2, 0)::INT AS line_y FROM words), lw AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY document_id, page_number, line_y ORDER BY x0, word_no) > 0.25 * page_width THEN 1 ELSE 0 END AS new FROM ln), lp AS (SELECT *, sum(new) OVER (PARTITION BY document_id, page_number, line_y ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING)::INT AS part FROM lw), lines AS (SELECT document_id, page_number, line_y, part, min(x0) AS \"left\", max(x1) AS \"right\", string_agg(text, ' ' ORDER BY x0, word_no) AS text FROM lp GROUP BY 1, 2, 3, 4)",
    "tagged": r"tagged AS (SELECT *, length(text) < 60 AND (regexp_matches(text, '\p{Nd}') OR length(text) < 20) AS tabular, (round_even('left' / 20, 0) * 20)::INT AS col_anchor FROM lines)".replace("'left'", '"left"'),
    "images": "images AS (SELECT chunk_id AS image_id, document_id, page_number, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order_index, chunk_id) - 1)::INT AS image_no, bbox.x0 * 612 AS x0, bbox.y0 * 792 AS y0, bbox.x1 * 612 AS x1, bbox.y1 * 792 AS y1 FROM ch WHERE chunk_type = 'chart_candidate')",
    "centres": "mw AS (SELECT document_id, page_number, round((x0 + x1) / 2, 6) AS m, x1 - x0 BETWEEN 0.08 AND 0.5 AS fits FROM texts), mk AS (SELECT document_id, page_number, m FROM mw QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY document_id, page_number)), md AS (SELECT DISTINCT * FROM mk), mg AS (SELECT *, m - lag(m) OVER (PARTITION BY document_id, page_number ORDER BY m) AS gap FROM md), ma AS (SELECT *, avg(gap) OVER (PARTITION BY document_id, page_number) AS mean_gap FROM mg), mc AS (SELECT *, sum(CASE WHEN gap > 1.5 * mean_gap OR gap >= 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY m ROWS UNBOUNDED PRECEDING) AS c FROM ma), ms AS (SELECT document_id, page_number, list(struct_pack(s := s, n := n) ORDER BY c) AS cs FROM (SELECT document_id, page_number, c, sum(m) AS s, count(*) AS n FROM mc GROUP BY ALL) GROUP BY ALL), mr AS (SELECT * FROM ms UNION ALL SELECT document_id, page_number, list_concat(list_concat(list_slice(cs, 1, k - 1), [struct_pack(s := cs[k].s + cs[k + 1].s, n := cs[k].n + cs[k + 1].n)]), list_slice(cs, k + 2, len(cs))) FROM (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT *, list_transform(range(1, len(cs)), lambda i: round(cs[i + 1].s / cs[i + 1].n - cs[i].s / cs[i].n, 9)) AS d FROM mr WHERE len(cs) > 3))), centres AS (SELECT document_id, page_number, (i - 1)::INT AS col_index, round(cs[i].s / cs[i].n, 6) AS centre FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM mr WHERE len(cs) <= 3))",
    "spans": "cb AS (SELECT document_id, page_number, col_index, round(coalesce((centre + lag(centre) OVER p) / 2, 0), 7) AS lo, round(coalesce((centre + lead(centre) OVER p) / 2, 1), 7) AS hi FROM centres WINDOW p AS (PARTITION BY document_id, page_number ORDER BY col_index)), sh AS (SELECT t.chunk_id, b.col_index, CASE WHEN x1 - x0 > 0 THEN round(greatest(0, least(x1, hi) - greatest(x0, lo)) / (x1 - x0), 9) ELSE 0 END AS share FROM texts t JOIN cb b ON b.document_id IS NOT DISTINCT FROM t.document_id AND b.page_number IS NOT DISTINCT FROM t.page_number QUALIFY row_number() OVER (PARTITION BY t.chunk_id ORDER BY share DESC, b.col_index) = 1), spans AS (SELECT t.*, CASE WHEN share >= 0.7 THEN sh.col_index ELSE -1 END::INT AS col_index, share < 0.7 AS spanning FROM texts t JOIN sh USING (chunk_id))",
    "paragraphs": r"pn AS (SELECT *, CASE WHEN round(y0 - lag(y1) OVER p, 9) < 0.015 THEN 0 ELSE 1 END AS new FROM spans WHERE NOT spanning WINDOW p AS (PARTITION BY document_id, page_number, col_index ORDER BY y0, block_no)), pr AS (SELECT *, sum(new) OVER (PARTITION BY document_id, page_number, col_index ORDER BY y0, block_no ROWS UNBOUNDED PRECEDING) AS run FROM pn), paragraphs AS (SELECT document_id, page_number, col_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, last(y1 ORDER BY y0, block_no) AS y1, regexp_extract(first(text ORDER BY y0, block_no), '^(\s*)', 1) || string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY y0, block_no) || regexp_extract(last(text ORDER BY y0, block_no), '(\s*)$', 1) AS text, first(block_no ORDER BY y0, block_no) AS first_block, count(*) AS n_blocks FROM pr GROUP BY document_id, page_number, col_index, run)",
    "ordered": "ob AS (SELECT document_id, page_number, col_index, y0, text, first_block, false AS spanning FROM paragraphs UNION ALL SELECT document_id, page_number, col_index, y0, text, block_no, true FROM spans WHERE spanning), om AS (SELECT *, bool_or(spanning) OVER (PARTITION BY document_id, page_number) AS mixed FROM ob), ordered AS (SELECT *, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY CASE WHEN mixed THEN 0 ELSE col_index END, y0, spanning DESC, first_block) - 1)::INT AS order_index FROM om)",
    "body": "tb AS (SELECT n.* FROM norm n JOIN ch USING (chunk_id) WHERE ch.chunk_type = 'table'), texts AS (SELECT * FROM (SELECT * FROM norm WHERE block_type = 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') a WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.document_id = a.document_id AND (a.y0 + a.y1) / 2 BETWEEN lo - 1e-9 AND b.hi + 1e-9) AND NOT EXISTS (SELECT 1 FROM tb b WHERE b.document_id = a.document_id AND b.page_number = a.page_number AND (a.x1 - a.x0) * (a.y1 - a.y0) > 0 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.3))",
    "vec": "vec AS (SELECT vec_id AS id, label AS grp, embedding FROM embeddings)",
}
_NEEDS = {"scoped": ("store",), "blocks": ("ch",), "norm": ("blocks",), "texts": ("norm",), "bands": ("norm",), "words": ("ch",), "lines": ("words",), "tagged": ("lines",), "images": ("ch",), "spans": ("centres",), "paragraphs": ("spans",), "ordered": ("paragraphs",)}


def _with(names: str, sql: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    head = ", ".join(CTES[n] for n in order)
    recursive = sql.strip().startswith("WITH RECURSIVE ") or "centres" in order
    tail = sql.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    if not head:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' + tail if sql.strip().startswith('WITH ') else ' ' + sql}"


def query(name: str, ctes: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _with(ctes, sql)
        return f

    return add


# --- views -----------------------------------------------------------------------------------------------------------


def _store(s: SparkSession, d: str, *columns: str) -> DataFrame:
    f = table(s, d, "facts")
    return store.latest_facts(f.select("fact_id", "ingest_seq", *[c for c in columns if c not in ("fact_id", "ingest_seq")]))


def _scoped(s: SparkSession, d: str, *columns: str) -> DataFrame:
    f = _store(s, d, "data_json", *columns)
    valid = F.when(F.try_parse_json("data_json").isNotNull(), F.col("data_json"))
    parts = [F.concat(F.lit(f'"{k}":"'), F.get_json_object(valid, f"$.temporal_scope.{k}"), F.lit('"')) for k in SCOPE_KEYS]
    return f.withColumn("scope", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).drop("data_json")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return store.latest_relationships(table(s, d, "relationships"))


def _ch(s: SparkSession, d: str) -> DataFrame:
    return pages.distinct_chunks(table(s, d, "chunks"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return pages.blocks_of(_ch(s, d))


def _norm(s: SparkSession, d: str) -> DataFrame:
    return layout.normalise_boxes(_blocks(s, d))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return layout.text_blocks(_norm(s, d))


def _vec(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), "embedding")


# --- sources and keyed writes ----------------------------------------------------------------------------------------


@query("blocks_scan", "blocks", r"SELECT chunk_id, document_id, page_number, block_no, text FROM blocks WHERE block_type = 0 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def blocks_scan(s, d):
    return layout.text_blocks(_blocks(s, d)).select("chunk_id", "document_id", "page_number", "block_no", "text")


@query("image_rect_dedup", "images", "SELECT document_id, page_number, round_even(x0, 2) AS r_x0, round_even(y0, 2) AS r_y0, round_even(x1, 2) AS r_x1, round_even(y1, 2) AS r_y1, min(image_no) AS image_no FROM images GROUP BY ALL")
def image_rect_dedup(s, d):
    return detection.distinct_images(pages.images_of(_ch(s, d)))


@query("fact_upsert_latest", "store", "SELECT fact_id, document_id, value, unit, batch_no, ingest_seq FROM store")
def fact_upsert_latest(s, d):
    return _store(s, d, "document_id", "value", "unit", "batch_no").select("fact_id", "document_id", "value", "unit", "batch_no", "ingest_seq")


_ASK = "SELECT min(fact_id) AS fact_id FROM store GROUP BY document_id"


@query("fact_detail", "store", f"SELECT s.fact_id, document_id, statement, canonical_entity, raw_attribute, value, unit, confidence, source_type, content_hash FROM store s JOIN ({_ASK}) a ON a.fact_id = s.fact_id")
def fact_detail(s, d):
    f = _store(s, d, "document_id", "statement", "canonical_entity", "raw_attribute", "value", "unit", "confidence", "source_type", "content_hash")
    asked = f.groupBy("document_id").agg(F.min("fact_id").alias("fact_id")).select("fact_id")
    return f.join(asked, "fact_id").drop("ingest_seq")


_DOC = "SELECT document_id FROM store WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


def _largest(f: DataFrame) -> DataFrame:
    return f.filter("document_id is not null").groupBy("document_id").count().orderBy(F.desc("count"), "document_id").limit(1).select("document_id")


@query("facts_by_document", "store", f"SELECT fact_id, document_id, statement, ingest_seq FROM store WHERE document_id = ({_DOC})")
def facts_by_document(s, d):
    f = _store(s, d, "document_id", "statement")
    return f.join(F.broadcast(_largest(f)), "document_id").select("fact_id", "document_id", "statement", "ingest_seq")


@query("corroboration_pairs", "edges", "SELECT fact_id_a, fact_id_b FROM edges WHERE relationship_type = 'corroborates'")
def corroboration_pairs(s, d):
    return _edges(s, d).filter("relationship_type = 'corroborates'").select("fact_id_a", "fact_id_b")


@query("relationship_symmetrize", "edges", "SELECT fact_id_a, fact_id_b, max_by(relationship_type, struct_pack(a := coalesce(created_at, '-infinity'::DOUBLE), b := coalesce(relationship_type, ''), c := coalesce(confidence, 0), d := coalesce(justification, ''))) AS relationship_type FROM (SELECT * FROM relationships UNION ALL SELECT fact_id_b, fact_id_a, relationship_type, confidence, justification, created_at FROM relationships) WHERE fact_id_a IS NOT NULL AND fact_id_b IS NOT NULL GROUP BY 1, 2")
def relationship_symmetrize(s, d):
    # SQL's max_by passes over null types: the latest row that has one counts, null only if none has
    return store.symmetric_upsert(table(s, d, "relationships"), typed_first=True).select("fact_id_a", "fact_id_b", "relationship_type")


@query("fact_doc_text", "store", "SELECT fact_id, document_id, concat_ws(' ', canonical_entity, raw_attribute, statement) AS doc_text FROM store")
def fact_doc_text(s, d):
    return _store(s, d, "document_id", "canonical_entity", "raw_attribute", "statement").select("fact_id", "document_id", F.concat_ws(" ", "canonical_entity", "raw_attribute", "statement").alias("doc_text"))


_GONE = "SELECT DISTINCT document_id FROM facts WHERE document_id LIKE '%-deck-%'"


@query("cascade_delete", "store edges", f"WITH gone AS (SELECT fact_id FROM store WHERE document_id IN ({_GONE})) SELECT 'fact' AS kind, fact_id AS id_a, '' AS id_b FROM store WHERE document_id IS NULL OR document_id NOT IN ({_GONE}) UNION ALL SELECT 'edge', fact_id_a, fact_id_b FROM edges WHERE fact_id_a NOT IN (FROM gone) AND fact_id_b NOT IN (FROM gone)")
def cascade_delete(s, d):
    listed = table(s, d, "facts").filter(F.col("document_id").like("%-deck-%")).select("document_id").distinct()
    facts, edges = store.cascade_delete(_store(s, d, "document_id"), _edges(s, d), listed)
    return facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id_a"), F.lit("").alias("id_b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("fact_id_a").alias("id_a"), F.col("fact_id_b").alias("id_b")))


@query("justification_truncate", "edges", "SELECT fact_id_a, fact_id_b, CASE WHEN lower(relationship_type) = 'contradicts' THEN substr(justification, 1, 413) ELSE justification END AS justification FROM edges")
def justification_truncate(s, d):
    return _edges(s, d).select("fact_id_a", "fact_id_b", F.when(F.lower("relationship_type") == "contradicts", F.substring("justification", 1, 413)).otherwise(F.col("justification")).alias("justification"))


@query("fact_search_like", "store", "SELECT fact_id, statement FROM store WHERE statement LIKE '%EBITDA%'")
def fact_search_like(s, d):
    return _store(s, d, "statement").filter(F.col("statement").like("%EBITDA%")).select("fact_id", "statement")


# --- layout ----------------------------------------------------------------------------------------------------------

_R6 = "round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1"


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.round(k, 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("bbox_normalize", "norm", f"SELECT chunk_id, {_R6} FROM norm")
def bbox_normalize(s, d):
    return _r6(_norm(s, d), "chunk_id")


@query("header_footer_bands", "bands", "SELECT * FROM bands")
def header_footer_bands(s, d):
    return layout.running_bands(_norm(s, d))


@query("strip_header_footer", "texts bands", "SELECT chunk_id, document_id, page_number FROM texts t WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.document_id = t.document_id AND (y0 + y1) / 2 BETWEEN lo - 1e-9 AND hi + 1e-9)")
def strip_header_footer(s, d):
    n = _norm(s, d)
    return layout.strip_bands(layout.text_blocks(n), layout.running_bands(n)).select("chunk_id", "document_id", "page_number")


@query("bbox_overlap_anti", "norm ch", "WITH tb AS (SELECT n.* FROM norm n JOIN ch USING (chunk_id) WHERE ch.chunk_type = 'table') SELECT chunk_id FROM norm a JOIN ch USING (chunk_id) WHERE ch.chunk_type = 'text' AND NOT EXISTS (SELECT 1 FROM tb b WHERE b.document_id = a.document_id AND b.page_number = a.page_number AND (a.x1 - a.x0) * (a.y1 - a.y0) > 0 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.3)")
def bbox_overlap_anti(s, d):
    c = _ch(s, d)
    n = layout.normalise_boxes(pages.blocks_of(c)).join(c.select("chunk_id", "chunk_type"), "chunk_id")
    return layout.without_covered(n.filter("chunk_type = 'text'"), n.filter("chunk_type = 'table'"), "chunk_id").select("chunk_id")


@query("column_centres", "texts centres", "SELECT document_id, page_number, col_index, centre FROM centres")
def column_centres(s, d):
    return layout.column_centres(_texts(s, d))


@query("column_assign", "texts centres", "SELECT chunk_id, col_index FROM texts t JOIN centres c ON c.document_id IS NOT DISTINCT FROM t.document_id AND c.page_number IS NOT DISTINCT FROM t.page_number QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(abs(round((x0 + x1) / 2, 6) - centre), 9), col_index) = 1")
def column_assign(s, d):
    t = _texts(s, d)
    return layout.assign_columns(t, layout.column_centres(t)).select("chunk_id", "col_index")


@query("column_bands", "texts spans", "SELECT document_id, page_number, col_index, lo, hi FROM cb")
def column_bands(s, d):
    return layout.column_bands(layout.column_centres(_texts(s, d)))


def _spans(s, d):
    t = _texts(s, d)
    return layout.classify_spans(t, layout.column_bands(layout.column_centres(t)))


@query("span_classify", "texts spans", "SELECT chunk_id, col_index, spanning FROM spans")
def span_classify(s, d):
    return _spans(s, d).select("chunk_id", "col_index", "spanning")


@query("paragraph_merge", "texts paragraphs", f"SELECT document_id, page_number, col_index, first_block, n_blocks, text, {_R6} FROM paragraphs")
def paragraph_merge(s, d):
    return _r6(layout.merge_paragraphs(_spans(s, d)), "document_id", "page_number", "col_index", "first_block", "n_blocks", "text")


@query("reading_order_blocks", "texts ordered", "SELECT document_id, page_number, first_block, spanning, order_index FROM ordered")
def reading_order_blocks(s, d):
    sp = _spans(s, d)
    return layout.order_blocks(layout.merge_paragraphs(sp), sp.filter("spanning")).select("document_id", "page_number", "first_block", "spanning", "order_index")


@query("layout_pipeline", "norm bands body ordered", "SELECT document_id, page_number, order_index, col_index, text FROM ordered")
def layout_pipeline(s, d):
    c = _ch(s, d)
    b = pages.blocks_of(c)
    return layout.layout(b, b.join(c.filter("chunk_type = 'table'").select("chunk_id"), "chunk_id", "left_semi")).select("document_id", "page_number", "order_index", "col_index", "text")


@query("column_diagnostics", "texts spans", "SELECT document_id, page_number, count(DISTINCT CASE WHEN NOT spanning THEN col_index END) AS n_columns, count(*) FILTER (NOT spanning) AS n_column_blocks, count(*) FILTER (spanning) AS n_spanning FROM spans GROUP BY 1, 2")
def column_diagnostics(s, d):
    return _spans(s, d).groupBy("document_id", "page_number").agg(F.countDistinct(F.when(~F.col("spanning"), F.col("col_index"))).alias("n_columns"), F.sum((~F.col("spanning")).cast("int")).alias("n_column_blocks"), F.sum(F.col("spanning").cast("int")).alias("n_spanning"))


@query("multi_column_pages", "texts centres", "SELECT document_id, page_number, count(*) AS n_columns FROM centres GROUP BY 1, 2 HAVING count(*) > 1")
def multi_column_pages(s, d):
    return layout.column_centres(_texts(s, d)).groupBy("document_id", "page_number").agg(F.count("*").alias("n_columns")).filter("n_columns > 1")


@query("reading_order", "ch", "SELECT chunk_id, document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY bbox.y0, bbox.x0, CASE chunk_type WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, chunk_id) - 1 AS order_index FROM ch")
def reading_order(s, d):
    return layout.reading_order(_ch(s, d))


# --- tables and charts -----------------------------------------------------------------------------------------------


@query("table_pass_priority", "ch", "WITH t AS (SELECT chunk_id, document_id, page_number, CASE WHEN len(table_data) >= 4 THEN 1 WHEN len(table_data) >= 2 THEN 2 ELSE 3 END AS pass FROM ch WHERE table_data IS NOT NULL) SELECT chunk_id, pass FROM t QUALIFY pass = min(pass) OVER (PARTITION BY document_id, page_number)")
def table_pass_priority(s, d):
    t = _ch(s, d).filter("table_data is not null").select("chunk_id", "document_id", "page_number", F.when(F.size("table_data") >= 4, 1).when(F.size("table_data") >= 2, 2).otherwise(3).alias("pass"))
    return detection.first_pass(t).select("chunk_id", "pass")


@query("table_sanitise", "ch", "SELECT chunk_id, list_transform(list_filter(table_data, lambda r: r IS NOT NULL), lambda r: list_transform(r, lambda c: coalesce(c, ''))) AS cells FROM ch WHERE table_data IS NOT NULL")
def table_sanitise(s, d):
    rows = F.filter("table_data", lambda r: r.isNotNull())
    return _ch(s, d).filter("table_data is not null").select("chunk_id", F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))).alias("cells"))


@query("table_candidate_lines", "lines", 'SELECT document_id, page_number, line_y, part, "left" AS x_left, "right" AS x_right, text FROM lines')
def table_candidate_lines(s, d):
    return detection.lines_of_words(pages.words_of(_ch(s, d))).withColumnsRenamed({"left": "x_left", "right": "x_right"})


@query("tabular_line_tag", "tagged", "SELECT document_id, page_number, line_y, part, tabular, col_anchor FROM tagged")
def tabular_line_tag(s, d):
    return detection.tag_tabular(detection.lines_of_words(pages.words_of(_ch(s, d)))).select("document_id", "page_number", "line_y", "part", "tabular", "col_anchor")


def _runs(s, d):
    return detection.tabular_runs(detection.tag_tabular(detection.lines_of_words(pages.words_of(_ch(s, d)))))


@query("tabular_runs")
def tabular_runs(s, d):
    return _runs(s, d)


@query("region_merge")
def region_merge(s, d):
    return detection.merge_regions(_runs(s, d), pages.PAGE_WIDTH, pages.PAGE_HEIGHT)


@query("chart_candidates", "images blocks", "SELECT image_id, document_id, page_number, image_no FROM images a WHERE x1 > x0 AND y1 > y0 AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.block_type = 0 AND b.document_id = a.document_id AND b.page_number = a.page_number AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.5)")
def chart_candidates(s, d):
    c = _ch(s, d)
    return detection.chart_candidates(pages.images_of(c), pages.blocks_of(c).filter("block_type = 0")).select("image_id", "document_id", "page_number", "image_no")


@query("caption_match", "images blocks", r"WITH hit AS (SELECT i.image_id, min_by(b.text, b.block_no) AS caption FROM images i JOIN blocks b ON b.document_id = i.document_id AND b.page_number = i.page_number WHERE b.block_type = 0 AND regexp_matches(b.text, '(?i)\b(figure|fig\.?|chart|diagram|exhibit|graph|plot|image|photo)\b') AND least(i.x1, b.x1) > greatest(i.x0, b.x0) AND ((i.y0 - b.y1) BETWEEN 0 AND 30 OR (b.y0 - i.y1) BETWEEN 0 AND 30) GROUP BY 1) SELECT image_id, caption FROM images LEFT JOIN hit USING (image_id)")
def caption_match(s, d):
    c = _ch(s, d)
    return detection.captions(pages.images_of(c), pages.blocks_of(c).filter("block_type = 0"))


@query("chunk_assemble", "ch", "SELECT chunk_id, chunk_type, text, len(table_data) AS n_rows, image_path FROM ch")
def chunk_assemble(s, d):
    c = _ch(s, d)
    base = ["chunk_id", "chunk_type"]
    t = c.filter("chunk_type = 'table'").select(*base, "text", F.when(F.col("table_data").isNotNull(), F.size("table_data")).cast("bigint").alias("n_rows"), "image_path")
    x = c.filter("chunk_type = 'text'").select(*base, "text", F.when(F.col("table_data").isNotNull(), F.size("table_data")).cast("bigint").alias("n_rows"), "image_path")
    g = c.filter("chunk_type is null or chunk_type not in ('table', 'text')").select(*base, "text", F.when(F.col("table_data").isNotNull(), F.size("table_data")).cast("bigint").alias("n_rows"), "image_path")
    return t.unionByName(x, allowMissingColumns=True).unionByName(g, allowMissingColumns=True)


# --- extraction ------------------------------------------------------------------------------------------------------


@query("keyword_filter", "ch", "SELECT chunk_id FROM ch WHERE text <> '' AND contains(lower(text), lower('Revenue'))")
def keyword_filter(s, d):
    return _ch(s, d).filter((F.col("text") != "") & F.contains(F.lower("text"), F.lower(F.lit("Revenue")))).select("chunk_id")


@query("context_window", "ch", r"WITH w AS (SELECT *, CASE WHEN chunk_type = 'text' AND text <> '' THEN text END AS t FROM ch) SELECT chunk_id, left(concat_ws(E'\n\n', lag(t) OVER p, CASE WHEN coalesce(text, '') <> '' THEN '>>> ' || text || ' <<<' END, lead(t) OVER p), 1000) AS context_window FROM w WINDOW p AS (PARTITION BY document_id, page_number ORDER BY reading_order_index, chunk_id)")
def context_window(s, d):
    return extraction.context_window(_ch(s, d)).select("chunk_id", "context_window")


_EQ = r"coalesce(length(text) > 0 AND ((regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[(\[][0-9a-zA-Z]+[)\]]$') AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 150) OR (length(text) - length(translate(text, '=+-*/√∑∏∫αβγδθλμΣΠ()[]{}^_', ''))) / length(text) > 0.15), false)"


@query("equation_filter", "", f"SELECT doc_id, {_EQ} AS filtered FROM documents")
def equation_filter(s, d):
    return table(s, d, "documents").select("doc_id", extraction.is_equation(F.col("text")).alias("filtered"))


@query("table_to_text", "ch", r"SELECT chunk_id, CASE WHEN text <> '' THEN 'Caption: ' || text || E'\n\n' ELSE '' END || coalesce(array_to_string(list_transform(list_filter(table_data, lambda r: r IS NOT NULL), lambda r: coalesce(array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '), '')), E'\n'), '') AS table_text FROM ch WHERE table_data IS NOT NULL")
def table_to_text(s, d):
    return _ch(s, d).filter("table_data is not null").select("chunk_id", extraction.table_text(F.col("table_data"), F.col("text")).alias("table_text"))


@query("prompt_route", "ch", "SELECT chunk_id, CASE chunk_type WHEN 'text' THEN 'text' WHEN 'table' THEN 'table' WHEN 'chart_candidate' THEN 'chart' END AS prompt, CASE chunk_type WHEN 'chart_candidate' THEN 'chart' WHEN 'table' THEN 'table' ELSE 'text' END AS source_type FROM ch")
def prompt_route(s, d):
    return _ch(s, d).select("chunk_id", extraction.route(F.col("chunk_type")).alias("prompt"), extraction.source_type(F.col("chunk_type")).alias("source_type"))


def _answers(s, d):
    """Stored records as a model's answers: one fact each."""
    f = _store(s, d, "data_json")
    return f.select(F.col("fact_id").alias("chunk_id"), F.concat(F.lit('{"facts":['), "data_json", F.lit("]}")).alias("answer"))


@query("llm_json_parse")
def llm_json_parse(s, d):
    return extraction.parse_answers(_answers(s, d)).select("chunk_id", "fact_no", "statement", "canonical_entity", "raw_attribute", "value", "confidence")


@query("llm_parse_rate")
def llm_parse_rate(s, d):
    a = _answers(s, d)
    ok = extraction.parse_answers(a).select("chunk_id").distinct().withColumn("ok", F.lit(1))
    return a.join(ok, "chunk_id", "left").agg(F.count("*").alias("n_answers"), F.sum(F.coalesce("ok", F.lit(0))).alias("n_valid"), F.round(F.avg(F.coalesce("ok", F.lit(0))) * 100, 4).alias("valid_percent"))


@query("evidence_gate", "store", "SELECT fact_id, source_type, source_type = 'chart' OR coalesce(CASE WHEN json_valid(data_json) THEN json_extract_string(data_json, '$.evidence_quote') END, '') <> '' AS passes FROM store")
def evidence_gate(s, d):
    quote = F.coalesce(F.get_json_object(F.when(F.try_parse_json("data_json").isNotNull(), F.col("data_json")), "$.evidence_quote"), F.lit(""))
    gate = F.when(F.col("source_type").isNull() & (quote == ""), F.lit(None).cast("boolean")).otherwise(extraction.passes_evidence_gate(F.col("source_type"), quote))
    return _store(s, d, "source_type", "data_json").select("fact_id", "source_type", gate.alias("passes"))


@query("fact_occurrences", "store ch", "WITH p AS (SELECT s.document_id, lower(content_hash) AS hash, c.page_number, c.bbox, min(struct_pack(q := ingest_seq, k := chunk_id)) AS at_ FROM store s JOIN ch c ON c.chunk_id = s.source_chunk_id GROUP BY 1, 2, 3, 4) SELECT document_id, hash, page_number, bbox.x0 AS x0, bbox.y0 AS y0, (row_number() OVER (PARTITION BY document_id, hash ORDER BY at_) - 1)::INT AS nth FROM p")
def fact_occurrences(s, d):
    return extraction.occurrences(_store(s, d, "document_id", "content_hash", "source_chunk_id"), _ch(s, d)).select("document_id", "hash", "page_number", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), "nth")


@query("content_hash", "scoped", r"SELECT fact_id, sha256(coalesce(canonical_entity, '') || '|' || coalesce(raw_attribute, '') || '|' || coalesce(lower(regexp_replace(value, '^\s+|\s+$', '', 'g')), '') || '|' || scope) AS hash FROM scoped")
def content_hash(s, d):
    return _scoped(s, d, "canonical_entity", "raw_attribute", "value").select("fact_id", extraction.content_hash(F.col("canonical_entity"), F.col("raw_attribute"), F.col("value"), F.col("scope")).alias("hash"))


@query("dedup_facts", "store", "SELECT document_id, lower(content_hash) AS hash, min_by(fact_id, ingest_seq) AS fact_id, count(*) AS n_facts, count(DISTINCT source_chunk_id) AS n_chunks FROM store GROUP BY 1, 2")
def dedup_facts(s, d):
    return extraction.dedup_within_document(_store(s, d, "document_id", "content_hash", "source_chunk_id")).withColumn("n_chunks", F.col("n_chunks").cast("bigint"))


# --- matching --------------------------------------------------------------------------------------------------------


def _names(s, d, column: str) -> DataFrame:
    return table(s, d, "facts").filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.min("ingest_seq").alias("first_seq"))


@query("cosine_similarity", "", "SELECT a.seq AS seq_a, b.seq AS seq_b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 5) + 0.0 AS similarity FROM (SELECT seq, embedding::DOUBLE[] AS e FROM canonical_entities) a JOIN (SELECT seq, embedding::DOUBLE[] AS e FROM canonical_entities) b ON a.seq < b.seq")
def cosine_similarity(s, d):
    e = table(s, d, "canonical_entities").select("seq", "embedding")
    a, b = e.toDF("seq_a", "va"), e.toDF("seq_b", "vb")
    return a.join(F.broadcast(b), F.col("seq_a") < F.col("seq_b")).select("seq_a", "seq_b", (F.round(similarity.cosine(F.col("va"), F.col("vb")), 5) + 0.0).alias("similarity"))


@query("entity_resolve")
def entity_resolve(s, d):
    emb = interfaces.HashEmbedder()
    return matching.resolve(interfaces.embed(_names(s, d, "canonical_entity").select("name"), emb), interfaces.embed(table(s, d, "canonical_entities").select("seq", "name"), emb))


@query("entity_registry_grow")
def entity_registry_grow(s, d):
    emb = interfaces.HashEmbedder()
    return matching.grow_registry(interfaces.embed(_names(s, d, "canonical_entity"), emb), interfaces.embed(table(s, d, "canonical_entities").select("seq", "name"), emb))


_PAIRS = "pairs AS (SELECT n.name, k.seq, k.name AS known FROM (SELECT DISTINCT raw_attribute AS name FROM facts WHERE trim(raw_attribute) <> '') n, canonical_attributes k)"
_INIT = "array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z]+'), lambda w: upper(w[1])), '')"
_UP = "(upper({0}) = {0} AND lower({0}) <> {0})"


def _attribute_names(s, d) -> tuple[DataFrame, DataFrame]:
    return _names(s, d, "raw_attribute").filter(F.trim("name") != "").select("name"), table(s, d, "canonical_attributes").select("seq", "name")


@query("acronym_match", "", f"WITH {_PAIRS} SELECT name, seq FROM pairs WHERE ({_UP.format('name')} AND length(name) >= 2 AND NOT {_UP.format('known')} AND {_INIT.format('known')} = name) OR ({_UP.format('known')} AND length(known) >= 2 AND NOT {_UP.format('name')} AND {_INIT.format('name')} = known)")
def acronym_match(s, d):
    return matching.acronym_pairs(*_attribute_names(s, d))


@query("prefix_match", "", f"WITH {_PAIRS} SELECT name, seq FROM pairs WHERE least(length(name), length(known)) >= 5 AND (starts_with(lower(name), lower(known)) OR starts_with(lower(known), lower(name)))")
def prefix_match(s, d):
    return matching.prefix_pairs(*_attribute_names(s, d))


@query("token_set_ratio")
def token_set_ratio(s, d):
    return matching.similar_words(*_attribute_names(s, d)).withColumn("score", F.round("score", 4))


@query("attribute_snap")
def attribute_snap(s, d):
    return matching.snap(_names(s, d, "raw_attribute").select("name"), table(s, d, "canonical_attributes").select("seq", "name"))


@query("attribute_cascade")
def attribute_cascade(s, d):
    emb = interfaces.HashEmbedder()
    return matching.snap_cascade(interfaces.embed(_names(s, d, "raw_attribute").select("name"), emb), interfaces.embed(table(s, d, "canonical_attributes").select("seq", "name"), emb))


@query("canonicalize_facts")
def canonicalize_facts(s, d):
    f = _scoped(s, d, "canonical_entity", "raw_attribute", "value", "unit")
    out = pipeline.canonicalise_facts(f, table(s, d, "canonical_entities"), table(s, d, "canonical_attributes"), interfaces.HashEmbedder())
    return out.select("fact_id", "entity", "attribute", "original_attribute", "normalized_value", "normalized_unit", "parse_ok", "content_hash")


@query("registry_contents", "", "SELECT seq, name, (SELECT count(*) FROM canonical_attributes) AS n_entries FROM canonical_attributes")
def registry_contents(s, d):
    a = table(s, d, "canonical_attributes").select("seq", "name")
    return a.join(F.broadcast(a.agg(F.count("*").alias("n_entries"))))


# --- units and periods -----------------------------------------------------------------------------------------------


def _values(s, d):
    return table(s, d, "facts").select("value", "unit").distinct()


_V = "v AS (SELECT DISTINCT value, unit FROM facts)"
_BARE = r"regexp_replace(replace(value, ',', ''), '^\s+|\s+$', '', 'g')"


def _sq(p: str) -> str:
    return p.replace("'", "''")


def _g(c: str, p: str, k: int) -> str:
    return f"nullif(regexp_extract({c}, '{_sq(p)}', {k}), '')"


def _key(raw: str) -> str:
    return f"CASE WHEN contains(lower({raw}), 'lakh') AND contains(lower({raw}), 'crore') THEN 'lakh crore' ELSE lower({raw}) END"


_SCALE = f"coalesce({_key(_g(_BARE, units.NUMERIC, 2))}, {_key(_g('unit', rf'(?i)\b({units.SCALE_WORDS})\b', 1))})"
_FACTOR = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in units.SCALES.items()) + " ELSE 1::DOUBLE END"
_NUM = f"{_g(_BARE, units.NUMERIC, 1)}::DOUBLE"


def _cur(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{m}') THEN '{code}'" for m, code in units.CURRENCIES) + " END"


def _per(c: str) -> tuple[str, str]:
    y1, y2, q, fy, yr = _g(c, units.FY_LONG, 1), _g(c, units.FY_LONG, 2), _g(c, units.QUARTER, 1), _g(c, units.FY_SHORT, 1), _g(c, units.YEAR, 1)
    qy = _g(c, units.QUARTER, 2)
    two = "CASE WHEN length({0}) = 2 THEN '20' || {0} ELSE {0} END"
    kind = f"CASE WHEN {y1} IS NOT NULL THEN 'FY' WHEN {q} IS NOT NULL THEN upper({q}) WHEN {fy} IS NOT NULL THEN 'FY' WHEN {yr} IS NOT NULL THEN 'annual' END"
    vintage = f"CASE WHEN {y1} IS NOT NULL THEN {y1} || '-' || CASE WHEN length({y2}) = 2 THEN substr({y1}, 1, 2) || {y2} ELSE {y2} END WHEN {q} IS NOT NULL THEN 'FY' || {two.format(qy)} WHEN {fy} IS NOT NULL THEN 'FY' || {two.format(fy)} ELSE {yr} END"
    return kind, vintage


@query("normalize_bps", "", f"WITH {_V} SELECT value, unit, {_g('value', units.BPS, 1)}::DOUBLE AS bps FROM v WHERE {_g('value', units.BPS, 1)} IS NOT NULL")
def normalize_bps(s, d):
    return _values(s, d).withColumn("bps", units.basis_points(F.col("value"))).filter("bps is not null")


@query("normalize_percent", "", f"WITH {_V} SELECT value, unit, {_g('value', units.PERCENT, 1)}::DOUBLE AS percent FROM v WHERE {_g('value', units.PERCENT, 1)} IS NOT NULL")
def normalize_percent(s, d):
    return _values(s, d).withColumn("percent", units.percent(F.col("value"))).filter("percent is not null")


@query("normalize_scale", "", f"WITH {_V}, k AS (SELECT value, unit, {_NUM} AS n, {_SCALE} AS scale FROM v) SELECT value, unit, scale, n * {_FACTOR.format('scale')} AS amount FROM k WHERE n IS NOT NULL")
def normalize_scale(s, d):
    k = _values(s, d).withColumn("n", units.number(F.col("value"))).withColumn("scale", units.scale_key(F.col("value"), F.col("unit")))
    return k.filter("n is not null").select("value", "unit", "scale", (F.col("n") * units.scale_factor(F.col("scale"))).alias("amount"))


@query("detect_currency", "", f"WITH {_V} SELECT value, unit, {_cur('value')} AS value_currency, {_cur('unit')} AS unit_currency FROM v")
def detect_currency(s, d):
    return _values(s, d).select("value", "unit", units.currency(F.col("value")).alias("value_currency"), units.currency(F.col("unit")).alias("unit_currency"))


@query("currency_conflict", "", f"WITH {_V} SELECT value, unit FROM v WHERE {_cur('value')} <> {_cur('unit')}")
def currency_conflict(s, d):
    return _values(s, d).filter(units.currency_conflict(F.col("value"), F.col("unit")))


_SAME = f"CASE WHEN value IS NULL AND unit IS NULL THEN true WHEN {_cur('value')} IS NULL AND {_cur('unit')} IS NULL THEN coalesce(value = unit, false) ELSE coalesce({_cur('value')} = {_cur('unit')}, false) END"


@query("same_currency", "", f"WITH {_V} SELECT value, unit, {_SAME} AS same FROM v")
def same_currency(s, d):
    return _values(s, d).withColumn("same", units.same_currency(F.col("value"), F.col("unit")))


@query("normalize_period", "", f"WITH t AS (SELECT DISTINCT statement AS text FROM facts WHERE statement IS NOT NULL), p AS (SELECT text, {_per('text')[0]} AS period, {_per('text')[1]} AS vintage FROM t) SELECT * FROM p WHERE period IS NOT NULL")
def normalize_period(s, d):
    t = table(s, d, "facts").filter("statement is not null").select(F.col("statement").alias("text")).distinct()
    return t.withColumn("p", units.period(F.col("text"))).select("text", "p.*").filter("period is not null")


_ST = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
_NORMALISED = f"""SELECT *, CASE WHEN bps IS NOT NULL THEN bps WHEN pct IS NOT NULL THEN pct WHEN n IS NOT NULL THEN n * {_FACTOR.format('scale')} END AS normalized_value,
  CASE WHEN bps IS NOT NULL THEN 'bps' WHEN pct IS NOT NULL THEN '%' WHEN n IS NOT NULL THEN coalesce(cv, cu, scale, nullif(unit, '')) WHEN pk IS NOT NULL THEN 'period' ELSE nullif(unit, '') END AS normalized_unit,
  CASE WHEN bps IS NULL AND pct IS NULL AND n IS NOT NULL THEN coalesce(cv, cu) END AS currency, coalesce(bps IS NULL AND pct IS NULL AND n IS NOT NULL AND cv <> cu, false) AS currency_conflict,
  CASE WHEN bps IS NULL AND pct IS NULL AND n IS NULL THEN pk END AS period, CASE WHEN bps IS NULL AND pct IS NULL AND n IS NULL THEN pv END AS vintage, bps IS NOT NULL OR pct IS NOT NULL OR n IS NOT NULL OR pk IS NOT NULL AS parse_ok
  FROM (SELECT *, {_g('value', units.BPS, 1)}::DOUBLE AS bps, {_g('value', units.PERCENT, 1)}::DOUBLE AS pct, {_NUM} AS n, {_SCALE} AS scale, {_cur('value')} AS cv, {_cur('unit')} AS cu, {_per(_ST)[0]} AS pk, {_per(_ST)[1]} AS pv FROM @FROM@)"""


@query("normalize_unit", "", f"WITH {_V} SELECT value, unit, normalized_value, normalized_unit, currency, currency_conflict, period, vintage, parse_ok FROM ({_NORMALISED.replace('@FROM@', 'v')})")
def normalize_unit(s, d):
    return units.with_normalized(_values(s, d))


# --- candidates ------------------------------------------------------------------------------------------------------


def _knn_sql(cond: str) -> str:
    return f"WITH p AS (SELECT a.id AS query_id, b.id AS neighbour_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM vec a JOIN vec b ON {cond}) SELECT query_id, neighbour_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM p QUALIFY rank <= 8"


def _knn(s, d, rule: str) -> DataFrame:
    return knn.top_k(_vec(s, d), _vec(s, d), 8, rule).withColumn("similarity", F.round("similarity", 6))


@query("knn_topk", "vec", _knn_sql("a.grp <> b.grp"))
def knn_topk(s, d):
    return _knn(s, d, "other_group")


@query("knn_exclude_self", "vec", _knn_sql("a.id <> b.id"))
def knn_exclude_self(s, d):
    return _knn(s, d, "other_id")


@query("knn_incremental", "vec", _knn_sql("a.grp <> b.grp AND b.id < a.id"))
def knn_incremental(s, d):
    return _knn(s, d, "earlier")


_CC = "cc AS (SELECT DISTINCT fact_id_a AS a, fact_id_b AS b FROM edges WHERE relationship_type = 'corroborates'), both_ways AS (SELECT a, b FROM cc UNION SELECT b, a FROM cc), reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other), roots AS (SELECT node, min(least(node, other)) AS root FROM reach GROUP BY node)"


def _roots(s, d):
    return graph.components(_edges(s, d).filter("relationship_type = 'corroborates'").select(F.col("fact_id_a").alias("a"), F.col("fact_id_b").alias("b")))


@query("corroboration_clusters", "edges", f"WITH RECURSIVE {_CC} SELECT node AS fact_id, root AS cluster_id FROM roots")
def corroboration_clusters(s, d):
    return _roots(s, d).select(F.col("node").alias("fact_id"), F.col("root").alias("cluster_id"))


_REPS = f"{_CC}, pl AS (SELECT fact_id, ingest_seq, coalesce(root, fact_id) AS root FROM store LEFT JOIN roots ON node = fact_id), fr AS (SELECT root, min_by(fact_id, ingest_seq) AS representative_id FROM pl GROUP BY 1), reps AS (SELECT fact_id, representative_id FROM pl JOIN fr USING (root))"


@query("cluster_representatives", "store edges", f"WITH RECURSIVE {_REPS} SELECT * FROM reps")
def cluster_representatives(s, d):
    return graph.representatives(_store(s, d), _roots(s, d))


@query("representative_candidates", "store edges", f"WITH RECURSIVE {_REPS} SELECT DISTINCT e.fact_id_a AS fact_id, r.representative_id FROM edges e JOIN reps r ON r.fact_id = e.fact_id_b WHERE e.fact_id_a <> r.representative_id")
def representative_candidates(s, d):
    reps = graph.representatives(_store(s, d), _roots(s, d)).select(F.col("fact_id").alias("fact_id_b"), "representative_id")
    return _edges(s, d).select(F.col("fact_id_a").alias("fact_id"), "fact_id_b").join(reps, "fact_id_b").filter("fact_id <> representative_id").select("fact_id", "representative_id").distinct()


@query("pair_dedup", "store edges", "SELECT DISTINCT least(fact_id_a, fact_id_b) AS id_a, greatest(fact_id_a, fact_id_b) AS id_b FROM edges e JOIN store x ON x.fact_id = fact_id_a JOIN store y ON y.fact_id = fact_id_b WHERE x.document_id <> y.document_id")
def pair_dedup(s, d):
    f = _store(s, d, "document_id").select("fact_id", "document_id")
    e = _edges(s, d).select("fact_id_a", "fact_id_b").join(f.toDF("fact_id_a", "doc_a"), "fact_id_a").join(f.toDF("fact_id_b", "doc_b"), "fact_id_b").filter("doc_a <> doc_b")
    return e.select(F.least("fact_id_a", "fact_id_b").alias("id_a"), F.greatest("fact_id_a", "fact_id_b").alias("id_b")).distinct()


@query("fact_relationships", "store edges", "SELECT e.fact_id_a AS fact_id, e.fact_id_b AS related_id, e.relationship_type, e.confidence, s.document_id, s.statement FROM edges e JOIN store s ON s.fact_id = e.fact_id_b")
def fact_relationships(s, d):
    f = _store(s, d, "document_id", "statement").drop("ingest_seq").withColumnRenamed("fact_id", "related_id")
    return _edges(s, d).select(F.col("fact_id_a").alias("fact_id"), F.col("fact_id_b").alias("related_id"), "relationship_type", "confidence").join(f, "related_id")


@query("relationship_report", "store edges", "SELECT e.fact_id_a, e.fact_id_b, e.relationship_type, x.value AS value_a, y.value AS value_b FROM edges e JOIN store x ON x.fact_id = e.fact_id_a JOIN store y ON y.fact_id = e.fact_id_b")
def relationship_report(s, d):
    f = _store(s, d, "value").select("fact_id", "value")
    return _edges(s, d).select("fact_id_a", "fact_id_b", "relationship_type").join(f.toDF("fact_id_a", "value_a"), "fact_id_a").join(f.toDF("fact_id_b", "value_b"), "fact_id_b")


@query("missing_facts", "store edges", "SELECT DISTINCT fact_id_b AS fact_id FROM edges WHERE fact_id_b NOT IN (SELECT fact_id FROM store)")
def missing_facts(s, d):
    return _edges(s, d).select(F.col("fact_id_b").alias("fact_id")).distinct().join(_store(s, d).select("fact_id"), "fact_id", "left_anti")


@query("fact_source_chunk", "store ch", "SELECT fact_id, chunk_id, chunk_type, page_number FROM store JOIN ch ON chunk_id = source_chunk_id")
def fact_source_chunk(s, d):
    c = _ch(s, d).select("chunk_id", "chunk_type", "page_number")
    return _store(s, d, "source_chunk_id").select("fact_id", F.col("source_chunk_id").alias("chunk_id")).join(c, "chunk_id")


# --- rule and judge --------------------------------------------------------------------------------------------------


def _rule_pairs(s, d, block: bool = False) -> DataFrame:
    return compare.judge_pairs(_edges(s, d).select("fact_id_a", "fact_id_b"), _scoped(s, d, "value", "unit"), block).drop("justification")


_TOL = "CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN {a} = 0 OR {b} = 0 THEN false ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) <= 0.01 END"
_SV = "list_transform(json_extract_string({0}, '$.*'), lambda x: lower(x))"
_YEAR = "list_filter(list_transform({0}, lambda v: CASE WHEN contains(v, 'fy23') OR contains(v, '2023') THEN 'fy23' WHEN contains(v, 'fy24') OR contains(v, '2024') THEN 'fy24' WHEN contains(v, 'fy25') OR contains(v, '2025') THEN 'fy25' END), lambda x: x IS NOT NULL)[1]"
_QTR = "list_filter(list_transform({0}, lambda v: CASE WHEN contains(v, 'q1') THEN 'q1' WHEN contains(v, 'q2') THEN 'q2' WHEN contains(v, 'q3') THEN 'q3' WHEN contains(v, 'q4') THEN 'q4' END), lambda x: x IS NOT NULL)[1]"
_SIDE = f"side AS (SELECT fact_id, normalized_value AS v, normalized_unit AS u, currency AS cur, parse_ok AS ok, scope, {_SV.format('scope')} AS sv FROM ({_NORMALISED.replace('@FROM@', 'scoped')})), sided AS (SELECT *, {_YEAR.format('sv')} AS y, {_QTR.format('sv')} AS q FROM side)"
_EQUIV = "CASE WHEN a.scope = b.scope THEN true WHEN a.y <> b.y THEN false WHEN a.q <> b.q THEN false WHEN (a.q IS NULL) <> (b.q IS NULL) THEN false ELSE coalesce(a.y = b.y, false) END"
_RULE = f"rule AS (SELECT e.fact_id_a, e.fact_id_b, CASE WHEN a.ok AND b.ok AND a.v IS NOT NULL AND b.v IS NOT NULL AND (a.u IS NOT DISTINCT FROM b.u OR abs(a.v) >= 1000) AND {_TOL.format(a='a.v', b='b.v')} AND len(a.sv) > 0 AND len(b.sv) > 0 THEN CASE WHEN {_EQUIV} THEN 'corroborates' ELSE 'reconciled' END END AS rule_verdict FROM edges e JOIN sided a ON a.fact_id = e.fact_id_a JOIN sided b ON b.fact_id = e.fact_id_b)"


@query("within_tolerance", "edges scoped", f"WITH {_SIDE} SELECT e.fact_id_a, e.fact_id_b, {_TOL.format(a='a.v', b='b.v')} AS close FROM edges e JOIN sided a ON a.fact_id = e.fact_id_a JOIN sided b ON b.fact_id = e.fact_id_b WHERE a.v IS NOT NULL AND b.v IS NOT NULL")
def within_tolerance(s, d):
    f = _scoped(s, d, "value", "unit")
    a, b = compare.normalised_side(f, "a"), compare.normalised_side(f, "b")
    e = _edges(s, d).select(F.col("fact_id_a").alias("a_id"), F.col("fact_id_b").alias("b_id")).join(a, "a_id").join(b, "b_id").filter("a_value is not null and b_value is not null")
    return e.select(F.col("a_id").alias("fact_id_a"), F.col("b_id").alias("fact_id_b"), compare.within_tolerance(F.col("a_value"), F.col("b_value")).alias("close"))


@query("equivalent_scopes", "edges scoped", f"WITH {_SIDE} SELECT e.fact_id_a, e.fact_id_b, {_EQUIV} AS same FROM edges e JOIN sided a ON a.fact_id = e.fact_id_a JOIN sided b ON b.fact_id = e.fact_id_b")
def equivalent_scopes(s, d):
    f = _scoped(s, d).select("fact_id", compare.scope_marks(F.col("scope")).alias("m"))
    e = _edges(s, d).select("fact_id_a", "fact_id_b").join(f.toDF("fact_id_a", "ma"), "fact_id_a").join(f.toDF("fact_id_b", "mb"), "fact_id_b")
    return e.select("fact_id_a", "fact_id_b", compare.same_marks(F.col("ma"), F.col("mb")).alias("same"))


@query("deterministic_reconcile", "edges scoped", f"WITH {_SIDE}, {_RULE} SELECT *, CASE WHEN rule_verdict IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM rule")
def deterministic_reconcile(s, d):
    return _rule_pairs(s, d)


_STRICT = _RULE.replace("len(a.sv) > 0", "coalesce(a.cur = b.cur, true) AND len(a.sv) > 0")


@query("deterministic_reconcile_strict", "edges scoped", f"WITH {_SIDE}, {_STRICT} SELECT *, CASE WHEN rule_verdict IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM rule")
def deterministic_reconcile_strict(s, d):
    return _rule_pairs(s, d, True)


@query("judge_queue", "edges scoped", f"WITH {_SIDE}, {_RULE} SELECT fact_id_a, fact_id_b FROM rule WHERE rule_verdict IS NULL")
def judge_queue(s, d):
    return _rule_pairs(s, d).filter("rule_verdict is null").select("fact_id_a", "fact_id_b")


@query("judge_response_parse", "edges", "SELECT fact_id_a, fact_id_b, relationship_type, confidence FROM edges WHERE relationship_type IN ('corroborates', 'contradicts', 'reconciled', 'ambiguous', 'unrelated') AND confidence IS NOT NULL AND justification IS NOT NULL")
def judge_response_parse(s, d):
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct("relationship_type", "confidence", "justification")), F.lit("\n```"))
    e = _edges(s, d).select("fact_id_a", "fact_id_b", compare.parse_judgement(answer).alias("j"))
    return e.filter("j is not null").select("fact_id_a", "fact_id_b", "j.relationship_type", "j.confidence")


_FIELD_JUDGE = "CASE WHEN x.canonical_entity IS DISTINCT FROM y.canonical_entity OR x.raw_attribute IS DISTINCT FROM y.raw_attribute THEN 'unrelated' WHEN x.value IS NOT DISTINCT FROM y.value THEN 'ambiguous' ELSE 'contradicts' END"
_VERDICTS = f"SELECT r.fact_id_a, r.fact_id_b, coalesce(rule_verdict, {_FIELD_JUDGE}) AS relationship_type, CASE WHEN rule_verdict IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN rule_verdict IS NULL THEN 'judge' ELSE 'rule' END AS source FROM rule r JOIN store x ON x.fact_id = r.fact_id_a JOIN store y ON y.fact_id = r.fact_id_b"
_JUDGED = ("statement", "canonical_entity", "raw_attribute", "value", "unit")


@query("judged_pairs", "edges scoped", f"WITH {_SIDE}, {_RULE} {_VERDICTS}")
def judged_pairs(s, d):
    f = _scoped(s, d, *_JUDGED)
    return interfaces.judged(compare.judge_pairs(_edges(s, d).select("fact_id_a", "fact_id_b"), f), f, interfaces.field_judge).drop("justification")


_NEAR = "fv AS (SELECT s.fact_id, s.document_id, s.ingest_seq, s.batch_no, list_concat(e.embedding, a.embedding)::DOUBLE[] AS v FROM store s JOIN canonical_entities e ON e.name = s.canonical_entity JOIN canonical_attributes a ON a.name = s.raw_attribute), nn AS (SELECT q.fact_id, b.fact_id AS other FROM fv q JOIN fv b ON b.ingest_seq < q.ingest_seq AND b.document_id IS DISTINCT FROM q.document_id WHERE q.batch_no = (SELECT max(batch_no) FROM store) QUALIFY row_number() OVER (PARTITION BY q.fact_id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.ingest_seq) <= 8), cand AS (SELECT DISTINCT nn.fact_id AS fact_id_a, r.representative_id AS fact_id_b FROM nn JOIN reps r ON r.fact_id = nn.other WHERE representative_id <> nn.fact_id)"


@query("compare_new_facts", "edges scoped", f"WITH RECURSIVE {_REPS}, {_NEAR}, {_SIDE}, {_RULE.replace('FROM edges e', 'FROM cand e')} {_VERDICTS}")
def compare_new_facts(s, d):
    """The last batch against all that came before: vectors of the listed entity and attribute, groups of the stored edges, rule, judge."""
    lists = [table(s, d, n).select(F.col("name").alias(c), F.col("embedding").alias(c[:1])) for n, c in (("canonical_entities", "canonical_entity"), ("canonical_attributes", "raw_attribute"))]
    f = _scoped(s, d, "document_id", "batch_no", *_JUDGED)
    for x in lists:
        f = f.join(F.broadcast(x), x.columns[0], "left")
    f = f.withColumn("embedding", F.when(F.col("c").isNotNull() & F.col("r").isNotNull(), F.concat("c", "r")))
    last = f.agg(F.max("batch_no")).first()[0]
    new = F.coalesce(F.col("batch_no") == last, F.lit(False))
    return pipeline.compare_new_facts(f.filter(new), f.filter(~new), _edges(s, d), interfaces.field_judge).drop("justification")


@query("rejudge_reconciled", "edges scoped", f"WITH {_SIDE}, {_RULE}, again AS ({_VERDICTS}), pick AS (SELECT a.* FROM again a JOIN edges e ON e.fact_id_a = a.fact_id_a AND e.fact_id_b = a.fact_id_b WHERE e.relationship_type = 'reconciled'), two AS (SELECT fact_id_a, fact_id_b, relationship_type FROM pick UNION ALL SELECT fact_id_b, fact_id_a, relationship_type FROM pick), best AS (SELECT fact_id_a, fact_id_b, max(relationship_type) AS relationship_type FROM two GROUP BY 1, 2) SELECT coalesce(b.fact_id_a, e.fact_id_a) AS fact_id_a, coalesce(b.fact_id_b, e.fact_id_b) AS fact_id_b, CASE WHEN b.fact_id_a IS NOT NULL THEN b.relationship_type ELSE e.relationship_type END AS relationship_type FROM edges e FULL JOIN best b ON b.fact_id_a = e.fact_id_a AND b.fact_id_b = e.fact_id_b")
def rejudge_reconciled(s, d):
    f, e = _scoped(s, d, *_JUDGED), _edges(s, d)
    return ingest.rejudge(e, e.filter("relationship_type = 'reconciled'"), f, interfaces.field_judge, 4e9).select("fact_id_a", "fact_id_b", "relationship_type")


@query("justifications", "edges", "SELECT relationship_type, justification FROM edges")
def justifications(s, d):
    return _edges(s, d).select("relationship_type", "justification")


@query("repair_relationships", "edges scoped", f"WITH {_SIDE}, {_RULE} SELECT e.fact_id_a, e.fact_id_b, CASE WHEN e.relationship_type = 'reconciled' AND rule_verdict = 'corroborates' THEN rule_verdict ELSE e.relationship_type END AS relationship_type FROM edges e LEFT JOIN rule r ON r.fact_id_a = e.fact_id_a AND r.fact_id_b = e.fact_id_b")
def repair_relationships(s, d):
    e = _edges(s, d).select("fact_id_a", "fact_id_b", "relationship_type")
    again = compare.judge_pairs(e.filter("relationship_type = 'reconciled'").select("fact_id_a", "fact_id_b"), _scoped(s, d, "value", "unit")).filter("rule_verdict = 'corroborates'")
    return e.join(again, ["fact_id_a", "fact_id_b"], "left").select("fact_id_a", "fact_id_b", F.coalesce("rule_verdict", "relationship_type").alias("relationship_type"))


_RULE_TEXT = ("The two figures agree", "Both sources give the same figure")


@query("verdict_source", "edges", f"SELECT CASE WHEN starts_with(justification, '{_RULE_TEXT[0]}') OR starts_with(justification, '{_RULE_TEXT[1]}') THEN 'rule' WHEN justification IS NULL THEN 'none' ELSE 'judge' END AS source, relationship_type, count(*) AS n FROM edges GROUP BY ALL")
def verdict_source(s, d):
    j = F.col("justification")
    source = F.when(j.startswith(_RULE_TEXT[0]) | j.startswith(_RULE_TEXT[1]), "rule").when(j.isNull(), "none").otherwise("judge")
    return _edges(s, d).groupBy(source.alias("source"), "relationship_type").agg(F.count("*").alias("n"))


@query("stale_empty_scope", "edges scoped", f"SELECT e.fact_id_a, e.fact_id_b FROM edges e JOIN scoped a ON a.fact_id = e.fact_id_a JOIN scoped b ON b.fact_id = e.fact_id_b WHERE e.relationship_type = 'reconciled' AND starts_with(e.justification, 'The periods differ') AND (a.scope = '{{}}' OR b.scope = '{{}}')")
def stale_empty_scope(s, d):
    f = _scoped(s, d).select("fact_id", "scope")
    e = _edges(s, d).filter(F.col("justification").startswith("The periods differ") & (F.col("relationship_type") == "reconciled")).select("fact_id_a", "fact_id_b")  # the rule's text for such verdicts in these tables
    return e.join(f.toDF("fact_id_a", "sa"), "fact_id_a").join(f.toDF("fact_id_b", "sb"), "fact_id_b").filter("sa = '{}' or sb = '{}'").select("fact_id_a", "fact_id_b")


# --- aggregates and reads --------------------------------------------------------------------------------------------


@query("relationship_counts", "edges", "SELECT relationship_type, count(*) // 2 AS n FROM edges GROUP BY 1")
def relationship_counts(s, d):
    return _edges(s, d).groupBy("relationship_type").agg(F.expr("count(*) div 2").alias("n"))


@query("document_summary", "store", "SELECT document_id, count(*) AS fact_count FROM store GROUP BY 1")
def document_summary(s, d):
    return _store(s, d, "document_id").groupBy("document_id").agg(F.count("*").alias("fact_count")).orderBy("document_id")


@query("system_status", "store edges", "SELECT 'documents' AS item, count(DISTINCT document_id) AS n FROM store UNION ALL SELECT 'facts', count(*) FROM store UNION ALL SELECT 'relationships ' || coalesce(relationship_type, 'null'), count(*) // 2 FROM edges GROUP BY 1")
def system_status(s, d):
    f = _store(s, d, "document_id")
    a = f.agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("facts")).select(F.explode(F.create_map(F.lit("documents"), "documents", F.lit("facts"), "facts")).alias("item", "n"))
    return a.unionByName(_edges(s, d).groupBy("relationship_type").agg(F.expr("count(*) div 2").alias("n")).select(F.concat(F.lit("relationships "), F.coalesce("relationship_type", F.lit("null"))).alias("item"), "n"))


@query("ingest_metrics", "edges", "SELECT coalesce(relationship_type, 'null') AS relationship_type, count(*) AS n, count(*) FILTER ((confidence = 1.0 AND contains(justification, 'within the')) OR contains(lower(justification), 'exact') OR contains(lower(justification), 'identical')) AS n_deterministic FROM edges GROUP BY 1")
def ingest_metrics(s, d):
    j = F.col("justification")
    det = ((F.col("confidence") == 1.0) & j.contains("within the")) | F.lower(j).contains("exact") | F.lower(j).contains("identical")
    return _edges(s, d).groupBy(F.coalesce("relationship_type", F.lit("null")).alias("relationship_type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(det, F.lit(False))).alias("n_deterministic"))


@query("chunk_histogram", "ch", "SELECT chunk_type, page_number, count(*) AS n FROM ch GROUP BY 1, 2")
def chunk_histogram(s, d):
    return _ch(s, d).groupBy("chunk_type", "page_number").agg(F.count("*").alias("n"))


@query("relationship_examples", "edges", "SELECT relationship_type, fact_id_a, fact_id_b, row_number() OVER (PARTITION BY relationship_type ORDER BY fact_id_a, fact_id_b) AS nth, count(*) OVER (PARTITION BY relationship_type) AS n FROM edges QUALIFY nth <= 3")
def relationship_examples(s, d):
    e = _edges(s, d)
    w = Window.partitionBy("relationship_type").orderBy("fact_id_a", "fact_id_b")
    top = e.select("relationship_type", "fact_id_a", "fact_id_b", F.row_number().over(w).alias("nth")).filter("nth <= 3")
    n = e.groupBy(F.col("relationship_type").alias("t")).agg(F.count("*").alias("n"))
    return top.join(n, F.col("relationship_type").eqNullSafe(F.col("t"))).drop("t")


@query("confidence_pips", "store", "SELECT fact_id, floor(confidence * 5 + 0.5)::BIGINT AS pips FROM store")
def confidence_pips(s, d):
    return _store(s, d, "confidence").select("fact_id", F.floor(F.col("confidence") * 5 + 0.5).alias("pips"))


@query("document_ids", "store", "SELECT DISTINCT document_id FROM store")
def document_ids(s, d):
    return _store(s, d, "document_id").select("document_id").distinct().orderBy("document_id")


@query("list_facts", "store", f"SELECT fact_id, document_id, canonical_entity, raw_attribute, value FROM store WHERE document_id = ({_DOC}) ORDER BY document_id, ingest_seq LIMIT 50 OFFSET 20")
def list_facts(s, d):
    f = _store(s, d, "document_id", "canonical_entity", "raw_attribute", "value")
    return store.page(f.join(F.broadcast(_largest(f)), "document_id"), 50, 20).select("fact_id", "document_id", "canonical_entity", "raw_attribute", "value")


@query("evidence_image_status", "store", "SELECT fact_id, CASE WHEN CASE WHEN json_valid(data_json) THEN json_extract_string(data_json, '$.context.image_path') END IS NULL THEN 400 ELSE 404 END AS status FROM store")
def evidence_image_status(s, d):
    """404: the image is not stored here; 400: the fact has none."""
    valid = F.when(F.try_parse_json("data_json").isNotNull(), F.col("data_json"))
    return _store(s, d, "data_json").select("fact_id", F.when(F.get_json_object(valid, "$.context.image_path").isNull(), 400).otherwise(404).alias("status"))


@query("keyword_sample", "ch", "SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order_index, chunk_id) AS nth FROM ch WHERE contains(lower(text), 'revenue') QUALIFY nth <= 15")
def keyword_sample(s, d):
    w = Window.partitionBy("document_id").orderBy("page_number", "reading_order_index", "chunk_id")
    return _ch(s, d).filter(F.contains(F.lower("text"), F.lit("revenue"))).select("document_id", "chunk_id", F.row_number().over(w).alias("nth")).filter("nth <= 15")


@query("chunk_sample", "ch", "SELECT document_id, chunk_type, chunk_id FROM ch QUALIFY row_number() OVER (PARTITION BY document_id, chunk_type ORDER BY page_number, reading_order_index, chunk_id) <= CASE WHEN chunk_type = 'text' THEN 3 ELSE 1 END")
def chunk_sample(s, d):
    w = Window.partitionBy("document_id", "chunk_type").orderBy("page_number", "reading_order_index", "chunk_id")
    c = _ch(s, d).select("document_id", "chunk_type", "chunk_id", F.row_number().over(w).alias("nth")).filter("nth <= 3")  # a constant: cut before the shuffle
    return c.filter(F.col("nth") <= F.when(F.col("chunk_type") == "text", 3).otherwise(1)).drop("nth")


@query("idempotent_ingest", "", "SELECT f.fact_id, f.ingest_seq FROM facts f WHERE batch_no >= 10 AND (document_id IS NULL OR document_id NOT IN (SELECT document_id FROM facts WHERE batch_no < 10 AND document_id IS NOT NULL))")
def idempotent_ingest(s, d):
    f = table(s, d, "facts").select("fact_id", "ingest_seq", "document_id", "batch_no")
    return ingest.new_documents(f.filter("batch_no >= 10"), f.filter("batch_no < 10")).select("fact_id", "ingest_seq")


@query("regex_line_audit", "", r"SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(line, '(?i)(password|secret|api[_-]?key|/home/|c:\\users|javascript)')")
def regex_line_audit(s, d):
    lines = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(r"(?i)(password|secret|api[_-]?key|/home/|c:\\users|javascript)")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("url_count", "ch", "SELECT chunk_id, len(regexp_extract_all(array_to_string(list_transform(list_filter(table_data, lambda r: r IS NOT NULL), lambda r: coalesce(array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' '), '')), ' '), 'http')) AS n FROM ch WHERE table_data IS NOT NULL AND len(table_data) > 0")
def url_count(s, d):
    """Links among a table's cells (the test tables have none, so all counts are 0)."""
    rows = F.filter("table_data", lambda r: r.isNotNull())
    joined = F.array_join(F.transform(rows, lambda r: F.array_join(r, " ", "")), " ")
    return _ch(s, d).filter("table_data is not null and size(table_data) > 0").select("chunk_id", F.regexp_count(joined, F.lit("http")).cast("bigint").alias("n"))
