"""Decision, geometry, sequential and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import decide, geometry, sequential
from tarnmill.plans import fixtures
from tarnmill.plans.fixtures import SERIES_SQL
from tarnmill.plans.blends import _WIDE, wide_predictions
from tarnmill.plans.fixtures import PREDS_SQL
from tarnmill.plans.registry import query
from tarnmill.sources.tables import table

_CLUSTER = """ SELECT study, CASE WHEN acl >= 0.45 AND (mcl >= 0.4 OR medial_meniscus >= 0.45 OR lateral_meniscus >= 0.45) AND (contusion >= 0.35 OR effusion >= 0.6) THEN 'multi_ligament_trauma'
 WHEN acl >= 0.5 THEN 'acl_rupture' WHEN medial_oa >= 0.5 OR lateral_oa >= 0.5 OR pf_oa >= 0.5 THEN 'osteoarthritis' WHEN medial_meniscus >= 0.5 OR lateral_meniscus >= 0.5 THEN 'meniscal_tear'
 WHEN effusion >= 0.65 OR synovitis >= 0.5 OR bakers >= 0.5 THEN 'effusion_synovitis' WHEN contusion >= 0.5 OR fracture >= 0.4 THEN 'contusion_fracture' ELSE 'normal_reference' END AS cluster FROM wide"""


@query("rule_cluster", PREDS_SQL + _WIDE + _CLUSTER)
def rule_cluster(spark, sf_dir):
    return wide_predictions(spark, sf_dir).select("study", decide.cluster().alias("cluster"))


def _recommend_sql() -> str:
    entries = ", ".join(f"({i}, '{e.finding}', '{e.product}', {e.tier}, [{', '.join(repr(k) for k in e.kit)}])" for i, e in enumerate(decide.CATALOG))
    return PREDS_SQL + _WIDE + f""", cat AS (SELECT * FROM (VALUES {entries}) AS c(i, target, product, tier, kit)),
a AS (SELECT study, cat.* FROM preds JOIN cat USING (target) WHERE model = 'm1' AND p >= 0.5),
items AS (SELECT study, item, min(row(-tier, i, k)) AS first FROM (SELECT study, tier, i, unnest(kit) AS item, unnest(range(len(kit))) AS k FROM a) GROUP BY 1, 2),
kits AS (SELECT study, string_agg(item, ',' ORDER BY first) AS kit FROM items GROUP BY 1),
ps AS (SELECT study, count(*) AS n, string_agg(product, ',' ORDER BY tier DESC, i) AS products, max(tier) AS top FROM a GROUP BY 1)
SELECT wide.study, coalesce(n, 0)::BIGINT AS n_findings, coalesce(products, '') AS products, coalesce(kit, '') AS kit, coalesce(top, 1)::BIGINT AS top_tier,
 array_to_string(list_filter([CASE WHEN acl >= 0.5 AND mcl >= 0.5 THEN 'multi_ligament' END, CASE WHEN acl >= 0.5 AND (medial_meniscus >= 0.5 OR lateral_meniscus >= 0.5) THEN 'acl_meniscus' END,
  CASE WHEN (medial_oa >= 0.5 OR lateral_oa >= 0.5 OR pf_oa >= 0.5) AND contusion >= 0.5 THEN 'oa_contusion' END, CASE WHEN (effusion >= 0.5 AND synovitis >= 0.5) OR bakers >= 0.5 THEN 'inflammatory' END,
  CASE WHEN fracture >= 0.5 AND (effusion >= 0.5 OR contusion >= 0.5) THEN 'fracture_haemarthrosis' END], lambda x: x IS NOT NULL), ',') AS synergies
FROM wide LEFT JOIN ps USING (study) LEFT JOIN kits USING (study)"""


@query("rule_recommend", _recommend_sql())
def rule_recommend(spark, sf_dir):
    return decide.recommend(wide_predictions(spark, sf_dir))


#: Linear maps of four measures to the 12 probabilities, constants by rule.
_MEASURES = ("l_quantity / 50", "l_discount * 10", "l_tax * 12", "l_extendedprice / 97003")
_MAPS = {t: (_MEASURES[k % 4], round(0.35 + 0.05 * k, 2), round(0.3 - 0.02 * k, 2)) for k, t in enumerate(fixtures.TARGETS)}
_BIOMARKERS = (
    "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
    + ", ".join(f"round(greatest(0.02::DOUBLE, least(0.98::DOUBLE, {slope}::DOUBLE * ({m.replace(' / ', '::DOUBLE / ').replace(' * ', '::DOUBLE * ')}) + {start}::DOUBLE)), 6) AS {t}" for t, (m, slope, start) in _MAPS.items())
    + " FROM lineitem) SELECT *, CASE greatest(" + ", ".join(_MAPS) + ") " + " ".join(f"WHEN {t} THEN '{t}'" for t in _MAPS) + " END AS likeliest FROM p"
)


@query("rule_biomarker_probs", _BIOMARKERS)
def rule_biomarker_probs(spark, sf_dir):
    """Twelve clipped linear maps and the target that they make the likeliest."""
    rows = table(spark, sf_dir, "lineitem").withColumns({f"_m{k}": F.expr(m).cast("double") for k, m in enumerate(_MEASURES)})
    maps = {t: (f"_m{k % 4}", slope, start) for k, (t, (_, slope, start)) in enumerate(_MAPS.items())}
    probs = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *decide.biomarker_probs(maps))
    rounded = probs.withColumns({t: F.round(t, 6) for t in maps})
    return rounded.withColumn("likeliest", decide.likeliest(list(maps)))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("e"))
    return v.select("vec_id", F.slice("e", 1, 6).alias("o"), F.slice("e", 7, 3).alias("pos"))


_VEC = """WITH e AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: round(x::DOUBLE, 4)) AS e FROM embeddings),
c AS (SELECT vec_id, e[7:9] AS p, e[2] * e[6] - e[3] * e[5] AS nx, e[3] * e[4] - e[1] * e[6] AS ny, e[1] * e[5] - e[2] * e[4] AS nz FROM e),
l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM c),
u AS (SELECT vec_id, p, CASE WHEN len > 1e-6 THEN nx / len ELSE 0 END AS x, CASE WHEN len > 1e-6 THEN ny / len ELSE 0 END AS y, CASE WHEN len > 1e-6 THEN nz / len ELSE 1 END AS z FROM l)"""


@query("vec_plane", _VEC + " SELECT vec_id, round(p[1] * x + p[2] * y + p[3] * z, 6) AS position, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'Sagittal' WHEN abs(y) >= abs(z) THEN 'Coronal' ELSE 'Axial' END AS plane FROM u")
def vec_plane(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(geometry.slice_position(F.col("pos"), F.col("o")), 6).alias("position"), geometry.plane(F.col("o")).alias("plane"))


@query("sort_slices", _VEC + ", q AS (SELECT vec_id, round(p[1] * x + p[2] * y + p[3] * z, 6) AS position FROM u) SELECT q.vec_id, label, row_number() OVER (PARTITION BY label ORDER BY position, q.vec_id) AS k FROM q JOIN embeddings USING (vec_id)")
def sort_slices(spark, sf_dir):
    from tarnmill.operators.ranking import row_number

    pos = vec_plane(spark, sf_dir).select("vec_id", "position").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return pos.select("vec_id", "label", row_number(["label"], [F.col("position"), F.col("vec_id")]).alias("k"))


@query("fold_multilabel", None)
def fold_multilabel(spark, sf_dir):
    wide = fixtures.one_model(spark, sf_dir).groupBy("study").pivot("target", list(fixtures.TARGETS)).agg(F.max("y"))
    return sequential.stratified_folds(wide, list(fixtures.TARGETS))


_QUOTA = """, z AS (SELECT study, plane, count(*) AS n FROM series GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY study)::BIGINT AS total FROM z),
w AS (SELECT *, (n * least(8, total)) // total AS whole, (n * least(8, total)) % total AS rest FROM s)
SELECT study, plane, (whole + (row_number() OVER (PARTITION BY study ORDER BY rest DESC, plane) <= least(8, total) - sum(whole) OVER (PARTITION BY study))::INT)::INT AS quota FROM w"""


@query("quota_allocate", SERIES_SQL + _QUOTA)
def quota_allocate(spark, sf_dir):
    return sequential.quota_per_group(fixtures.series(spark, sf_dir), "study", "plane", 8)


def _unused_sql() -> str:
    """Each slot takes the first unused row of its kind, one with the wanted flag before others."""
    out, used = SERIES_SQL + """, r AS (SELECT study, plane, fluid, l_partkey::BIGINT AS l_partkey, row_number() OVER (PARTITION BY study ORDER BY seq, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i FROM series)""", []
    for n, (kind, wish) in enumerate((("A", 1), ("A", 0), ("N", 1), ("R", 1))):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM {u} WHERE {u}.study = r.study AND {u}.i = r.i)" for u in used)
        out += f", s{n} AS (SELECT study, i, {n} AS slot, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY (fluid = {wish}) DESC, i) AS k FROM r WHERE plane = '{kind}'{free}) WHERE k = 1)"
        used.append(f"s{n}")
    return out + " " + " UNION ALL ".join(f"SELECT study, slot, l_partkey FROM {u}" for u in used)


@query("pick_prefer_unused", _unused_sql())
def pick_prefer_unused(spark, sf_dir):
    rows = fixtures.series(spark, sf_dir).withColumn("l_partkey", F.col("l_partkey").cast("bigint"))
    return sequential.pick_unused(rows, "study", ["seq", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], [("A", 1), ("A", 0), ("N", 1), ("R", 1)], "plane", "fluid", "l_partkey")


@query("scan_csv", "SELECT doc_id, quality, toxic FROM labels")
def scan_csv(spark, sf_dir):
    """A round trip through CSV with a header, ids as text and an explicit schema."""
    from tarnmill.sources import files

    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "labels").withColumn("doc_id", F.col("doc_id").cast("string")), path)
    return files.read_csv(spark, path, "doc_id string, quality int, toxic int").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")


@query("scan_csv_dtype", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def scan_csv_dtype(spark, sf_dir):
    """Ids as text and two of the columns: the header is peeked at for the schema, and the scan is pruned to what is used."""
    from tarnmill.sources import files

    path = files.scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer"), path)
    return files.read_columns(spark, path, ["c_custkey", "c_mktsegment"], {"c_custkey": "string", "c_mktsegment": "string"})


@query("scan_embedded", "SELECT * FROM (VALUES ('acl', 0.7::DOUBLE), ('mcl', 0.5::DOUBLE), ('effusion', NULL)) AS t(target, weight)")
def scan_embedded(spark, sf_dir):
    """A table that travels inside the code, made here from its three lines."""
    import base64
    import gzip

    from tarnmill.sources import files

    payload = base64.b64encode(gzip.compress(b"target,weight\nacl,0.7\nmcl,0.5\neffusion,\n")).decode()
    return files.read_embedded(spark, payload, "target string, weight double")


@query("scan_binary_tree", "SELECT source AS grp, count(*) AS n_lines, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS n_bytes FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source")
def scan_binary_tree(spark, sf_dir):
    """Files below a folder, one folder a group, with their contents: the ids of each source, in as many files as tasks
    wrote."""
    from tarnmill.sources import files

    path = files.scratch(spark, "tree")
    ids = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND doc_id IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("value"))
    ids.write.partitionBy("source").text(path)
    found = files.read_binary_tree(spark, path, "*.txt")
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n", -1)) - 1
    return found.groupBy(F.regexp_replace("group", "^source=", "").alias("grp")).agg(F.sum(lines).alias("n_lines"), F.sum("length").alias("n_bytes"))


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(spark, sf_dir):
    from tarnmill.sources import files

    path = files.scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations")
    rows.write.json(path)
    return files.read_jsonl(spark, path, rows.schema)


@query("scan_optional", "SELECT doc_id, quality FROM labels WHERE false")
def scan_optional(spark, sf_dir):
    from tarnmill.sources import files

    return files.read_optional(spark, f"{sf_dir}/no_such_table.parquet", "doc_id bigint, quality int")


@query("scan_priority", "SELECT doc_id, quality, toxic FROM labels")
def scan_priority(spark, sf_dir):
    from tarnmill.sources import files

    return files.read_first(spark, [f"{sf_dir}/no_such_table.parquet", f"{sf_dir}/labels.parquet", f"{sf_dir}/documents.parquet"])
