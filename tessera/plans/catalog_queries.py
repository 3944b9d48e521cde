"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..model import CANONICAL, FLOOR, U64
from ..operators import catalog, identity, layout, profiles
from . import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_DOCS = "d AS (SELECT 'doc/' || doc_id AS name, octet_length(encode(coalesce(text, ''))) AS length, coalesce(text, '') AS content, doc_id, lang, source FROM documents)"
_UP = "((length + 65535) // 65536 * 65536)"
_PLACED = f"WITH {_DOCS}, p AS (SELECT *, 65536 + coalesce(sum({_UP}) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM d)"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return layout.canonical_placement(tables.document_blobs(spark, folder, ()))


# --- listing and lookup -----------------------------------------------------------------------------------------------------


@query("""SELECT 'emb/' || vec_id AS name, 'f32' AS dtype, '[' || len(embedding) || ']' AS shape, 'dense' AS layout, 1::BIGINT AS n_parts,
  (len(embedding) * 4)::BIGINT AS nbytes, (len(embedding) * 4) || ' B' AS human FROM embeddings ORDER BY name""")
def catalog_listing(spark, folder):
    return catalog.listing(tables.embedding_objects(spark, folder), tables.embedding_parts(spark, folder)).orderBy("name")


@query("SELECT 'emb/' || vec_id AS name, '[' || len(embedding) || ']' AS shape, label::VARCHAR AS label FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, folder):
    found = catalog.lookup(tables.embedding_objects(spark, folder), "emb/7")
    return found.select("name", X.shape_text(F.col("shape")).alias("shape"), F.get_json_object("attributes", "$.label").alias("label"))


@query("SELECT 'doc/' || doc_id AS name FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def membership(spark, folder):
    names = tables.read(spark, folder, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"))
    return catalog.members(names, tables.document_blobs(spark, folder, ()).select("name"))


@query("""SELECT 'conv/' || conv_id AS name, CASE WHEN count(*) = 1 THEN min(turn)::VARCHAR END AS part,
  string_agg(turn::VARCHAR, ',' ORDER BY turn::VARCHAR) AS choices FROM conversations GROUP BY conv_id""")
def only_part(spark, folder):
    src = tables.read(spark, folder, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("name"), F.col("turn").cast("string").alias("part"))
    return catalog.only_part(src)


@query("""WITH g AS (SELECT l_orderkey % 100 AS g, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT 'f64' AS dtype, n * 8 AS b FROM g UNION ALL SELECT 'f64', n * 8 FROM g UNION ALL SELECT 'i32', n * 4 FROM g UNION ALL SELECT 'i64', n * 8 FROM g
  UNION ALL SELECT 'f32', len(embedding) * 4 FROM embeddings UNION ALL SELECT 'u8', octet_length(encode(coalesce(text, ''))) FROM documents)
SELECT dtype, count(*) AS n_parts, sum(b)::BIGINT AS nbytes FROM p GROUP BY dtype""")
def nbytes_by_dtype(spark, folder):
    parts = tables.line_columns(spark, folder).select("dtype", "length")
    parts = parts.union(tables.embedding_parts(spark, folder).select("dtype", "length")).union(tables.document_blobs(spark, folder, ()).select("dtype", "length"))
    return parts.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("length").alias("nbytes"))


@query("""SELECT vec_id, json_extract_string('{"label": ' || label || '}', '$.label') AS label FROM embeddings""")
def attribute_lookup(spark, folder):
    src = tables.read(spark, folder, "embeddings").select("vec_id", F.parse_json(F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}"))).alias("a"))
    return src.select("vec_id", F.variant_get("a", "$.label", "string").alias("label"))


@query("""SELECT 'doc/' || doc_id AS name, octet_length(encode(coalesce(text, ''))) AS nbytes, sha256(coalesce(text, '')) AS sha256
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def selective_read(spark, folder):
    """The bytes of the tensors that are asked for by name only: the filter on names comes before the bytes."""
    names = tables.read(spark, folder, "labels").where("quality = 1").select("doc_id").distinct()
    got = tables.document_blobs(spark, folder).join(names, "doc_id", "left_semi")
    return got.select("name", F.col("length").cast("int").alias("nbytes"), F.sha2("content", 256).alias("sha256"))


@query("""SELECT lang AS name, count(*) AS n_parts, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS nbytes,
  CASE WHEN sum(octet_length(encode(coalesce(text, '')))) < 1024 THEN 'B' WHEN sum(octet_length(encode(coalesce(text, '')))) < 1048576 THEN 'KiB' ELSE 'MiB' END AS unit FROM documents GROUP BY lang""")
def listing_by_group(spark, folder):
    src = tables.document_blobs(spark, folder, ()).groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("length").alias("nbytes"))
    return src.withColumn("unit", F.element_at(F.split(X.human_size(F.col("nbytes")), " "), 2))


# --- types, sizes, rules ------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey::HUGEINT * 1000000000000000) AS a, l_suppkey::HUGEINT * 1000 AS b, (l_linenumber - 1)::HUGEINT AS c FROM lineitem),
f AS (SELECT *, CASE WHEN a <= 18446744073709551615 THEN a END AS x FROM s),
g AS (SELECT *, CASE WHEN x * b <= 18446744073709551615 THEN x * b END AS y FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN y * c <= 18446744073709551615 THEN y * c END)::VARCHAR AS n FROM g""")
def shape_product(spark, folder):
    li = tables.read(spark, folder, "lineitem")
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731 - a first dimension may lie beyond 64 bits: that is for the product to reject
    dims = F.array(*(c.cast("decimal(38,0)") for c in (wide("l_partkey") * 10**15, wide("l_suppkey") * 1000, wide("l_linenumber") - 1)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.num_elements(dims).cast("decimal(20,0)").cast("string").alias("n"))


@query("""SELECT 'emb/' || vec_id AS name, (len(embedding) * 4)::VARCHAR AS needed, len(embedding) * 4 - (CASE WHEN vec_id % 9 = 0 THEN 4 ELSE 0 END) AS stored
FROM embeddings WHERE vec_id % 9 = 0 AND len(embedding) > 0""")
def dense_size_check(spark, folder):
    """Every ninth part was cut short by an element: those are found."""
    cut = F.substring_index("name", "/", -1).cast("long") % 9 == 0
    parts = tables.embedding_parts(spark, folder).withColumn("length", F.col("length") - F.when(cut, 4).otherwise(0))
    got = catalog.dense_sizes(tables.embedding_objects(spark, folder), parts).where("needed <> nbytes")
    return got.select("name", F.col("needed").cast("decimal(20,0)").cast("string").alias("needed"), F.col("nbytes").cast("int").alias("stored"))


@query("""WITH n AS (SELECT doc_id, coalesce(text, '') AS name FROM documents)
SELECT doc_id, octet_length(encode(name)) AS bytes FROM n WHERE octet_length(encode(name)) NOT BETWEEN 1 AND 1024 OR contains(name, chr(0))""")
def name_rule_violations(spark, folder):
    src = tables.read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("name"))
    return src.where(~X.name_ok(F.col("name"))).select("doc_id", F.octet_length("name").alias("bytes"))


@query("""SELECT page_id, regexp_full_match(replace(url, 'https://', ''), '[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}') AS whole_ok,
  regexp_full_match(split_part(replace(url, 'https://', ''), '/', 1), '[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}') AS host_ok FROM pages""")
def shard_name_rules(spark, folder):
    bare = F.replace("url", F.lit("https://"), F.lit(""))
    return tables.read(spark, folder, "pages").select("page_id", X.shard_name_ok(bare).alias("whole_ok"), X.shard_name_ok(F.split_part(bare, F.lit("/"), F.lit(1))).alias("host_ok"))


@query("""SELECT doc_id, regexp_full_match(CASE WHEN doc_id % 3 = 0 THEN upper(sha256(coalesce(text, ''))) WHEN doc_id % 3 = 1 THEN 'sha256:' || sha256(coalesce(text, '')) ELSE 'sha256:' END, '[a-z0-9]+:[0-9a-f]+') AS ok FROM documents""")
def digest_syntax(spark, folder):
    """Three spellings of a digest, of which one is right."""
    h = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    spelt = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("sha256:"), h)).otherwise("sha256:")
    return tables.read(spark, folder, "documents").select("doc_id", X.digest_ok(spelt).alias("ok"))


@query("""SELECT p_partkey, p_size, ((p_size + 1) // 2)::VARCHAR AS f4, (p_size * 8)::VARCHAR AS complex64, (p_size * 2)::VARCHAR AS bf16, 'u8' AS pinned FROM part""")
def logical_sizes(spark, folder):
    n = F.col("p_size").cast("decimal(38,0)")
    text = lambda c: c.cast("decimal(20,0)").cast("string")
    return tables.read(spark, folder, "part").select(
        "p_partkey", "p_size", text(X.size_of(F.lit("f4_e2m1"), F.lit("u8"), n)).alias("f4"), text(X.size_of(F.lit("complex64"), F.lit("f32"), n)).alias("complex64"),
        text(X.size_of(F.lit(None).cast("string"), F.lit("bf16"), n)).alias("bf16"), X.pinned_dtype(F.lit("f4_e2m1")).alias("pinned"),
    )


@query("""SELECT p_partkey, row_number() OVER (ORDER BY octet_length(encode(p_name)), p_name, p_partkey) AS place FROM part""")
def cbor_key_order(spark, folder):
    """Places in the order of encoded keys: lengths first, counted at two levels so that no task sorts all keys."""
    src = tables.read(spark, folder, "part").select("p_partkey", "p_name").withColumn("n", F.octet_length("p_name"))
    got = layout.prefix_sum(src, F.lit(1).cast("long"), ["p_name", "p_partkey"], "before", F.struct("n", F.substring("p_name", 1, 4)))
    return got.select("p_partkey", (F.col("before") + 1).alias("place"))


# --- layout -------------------------------------------------------------------------------------------------------------------


@query(_PLACED + " SELECT name, length, \"offset\" FROM p")
def canonical_placement(spark, folder):
    return _placed(spark, folder).select("name", "length", "offset")


@query(f"""WITH {_DOCS} SELECT sum(length)::BIGINT AS payload, sum((length + 4095) // 4096 * 4096)::BIGINT AS at_floor, sum({_UP})::BIGINT AS canonical FROM d""")
def floor_vs_canonical_overhead(spark, folder):
    docs, n = tables.document_blobs(spark, folder, ()), F.col("length")
    return docs.agg(F.sum(n).alias("payload"), F.sum(X.align_up(n, FLOOR)).alias("at_floor"), F.sum(X.align_up(n, CANONICAL)).alias("canonical"))


@query(_PLACED + """, b AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN "offset" + 4096 ELSE "offset" END AS o FROM p WHERE length > 0),
w AS (SELECT *, coalesce(max((o + length + 65535) // 65536 * 65536) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 65536) AS e,
  first_value(o) OVER (PARTITION BY sha256(content), length ORDER BY name) AS f FROM b)
SELECT name, 1 AS rule, 'expected ' || e::BIGINT AS detail FROM w WHERE o <> e
UNION ALL SELECT name, 2, o::VARCHAR FROM w WHERE o % 65536 <> 0
UNION ALL SELECT name, 3, 'content at ' || f FROM w WHERE o <> f""")
def canonical_violations(spark, folder):
    """Placed documents of which every fiftieth was moved by a page, and none share their content."""
    bad = F.when(F.col("doc_id") % 50 == 0, F.col("offset") + 4096).otherwise(F.col("offset"))
    digests = tables.document_blobs(spark, folder).select("name", F.sha2("content", 256).alias("digest"))
    placed = _placed(spark, folder).where("length > 0").withColumn("offset", bad).join(digests, "name")
    return layout.canonical_violations(placed).select("name", "rule", "detail")


_BLOBS = "b AS (SELECT source, (doc_id // 60 * 100)::BIGINT AS \"offset\", (doc_id % 140)::BIGINT AS length FROM documents)"


def _blobs(spark, folder):
    return tables.read(spark, folder, "documents").select("source", (F.floor(F.col("doc_id") / 60) * 100).cast("long").alias("offset"), (F.col("doc_id") % 140).cast("long").alias("length"))


@query(f"""WITH {_BLOBS}, r AS (SELECT DISTINCT * FROM b WHERE length > 0),
w AS (SELECT *, max("offset" + length) OVER (PARTITION BY source ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
SELECT * FROM w WHERE reach > "offset" """)
def blob_overlap(spark, folder):
    return layout.overlaps(_blobs(spark, folder), "source")


@query("""WITH b AS (SELECT user_id, event_id, event_id % 7 AS length, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) - event_id % 7 + (CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS "offset" FROM events WHERE event_id % 7 > 0),
w AS (SELECT *, coalesce(lag("offset" + length) OVER (PARTITION BY user_id ORDER BY "offset", length), 0) AS expected FROM b)
SELECT user_id, event_id, "offset"::BIGINT AS "offset", expected::BIGINT AS expected FROM w WHERE "offset" <> expected""")
def exact_tiling(spark, folder):
    """Events as ranges that tile each user's section, a few of them moved by a byte. One of a byte then has the range of its
    next, if that has a byte too: the earlier event is first, as in the SQL's order of rows."""
    size = F.col("event_id") % 7
    src = tables.read(spark, folder, "events").where(size > 0).withColumn("length", size)
    start = F.sum("length").over(Window.partitionBy("user_id").orderBy("event_id")) - F.col("length") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return layout.tiling_faults(src.withColumn("offset", start), "user_id", ("event_id",)).select("user_id", "event_id", "offset", "expected")


@query(f"""WITH {_BLOBS}, r AS (SELECT DISTINCT * FROM b WHERE length > 0),
w AS (SELECT *, max("offset" + length) OVER (PARTITION BY source ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, lead("offset") OVER (PARTITION BY source ORDER BY "offset", length) AS n FROM r)
SELECT source, "offset", length, (p IS NULL OR p <= "offset" // 4096 * 4096) AND (n IS NULL OR n >= ("offset" + length + 4095) // 4096 * 4096) AS exclusive FROM w""")
def page_exclusive(spark, folder):
    return layout.page_exclusive(_blobs(spark, folder).where("length > 0").distinct(), "source")


@query("""WITH o AS (SELECT doc_id, (doc_id * 4096 * (1 + doc_id % 4))::BIGINT AS "offset" FROM documents)
SELECT doc_id, CASE WHEN "offset" = 0 THEN 4096 ELSE "offset" & -"offset" END AS alignment FROM o""")
def offset_alignment(spark, folder):
    offset = F.col("doc_id") * 4096 * (1 + F.col("doc_id") % 4)
    return tables.read(spark, folder, "documents").select("doc_id", X.alignment_of(offset).alias("alignment"))


@query("""WITH o AS (SELECT source, (doc_id * 8192)::BIGINT AS "offset" FROM documents), g AS (SELECT source, bit_or("offset") AS x FROM o GROUP BY source)
SELECT source, least(greatest(CASE WHEN x = 0 THEN 4096 ELSE x & -x END, 4096), 65536) AS alignment FROM g""")
def inherited_alignment(spark, folder):
    return layout.inherited_alignment(tables.read(spark, folder, "documents").select("source", (F.col("doc_id") * 8192).alias("offset")), "source")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM o)
SELECT l_orderkey, count(*) AS unsorted FROM w WHERE p >= l_partkey GROUP BY l_orderkey""")
def sorted_insertion(spark, folder):
    li = tables.read(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("name"))
    return layout.unsorted_insertions(li, "l_linenumber", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("unsorted"))


@query(f"""WITH {_DOCS} SELECT name, (coalesce(sum(length) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 262144)::BIGINT AS shard FROM d""")
def shard_plan(spark, folder):
    return layout.shard_plan(tables.document_blobs(spark, folder, ()), 262144).select("name", "shard")


@query("""WITH c AS (SELECT user_id, count(DISTINCT event_id % 16) AS present FROM events GROUP BY user_id), s AS (SELECT c_custkey AS user_id, 100 AS extent FROM customer)
SELECT user_id, coalesce(present, 0)::BIGINT AS present, 15::BIGINT AS needed FROM s LEFT JOIN c USING (user_id)""")
def chunk_coverage(spark, folder):
    chunks = tables.read(spark, folder, "events").select("user_id", (F.col("event_id") % 16).alias("chunk"))
    shapes = tables.read(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(100).alias("extent"), F.lit(7).alias("chunk_extent"))
    return layout.chunk_coverage(chunks, shapes, "user_id")


# --- identity -----------------------------------------------------------------------------------------------------------------


@query("SELECT 'doc/' || doc_id AS name, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")
def part_digest(spark, folder):
    return identity.with_digests(tables.document_blobs(spark, folder)).select("name", "digest")


_CLAIM = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'sha256:' || sha256(coalesce(text, '') || '!') ELSE 'sha256:' || sha256(coalesce(text, '')) END"


def _claimed(spark, folder):
    claim = F.when(F.col("doc_id") % 13 == 0, X.sha256_digest(F.concat(F.col("content"), F.lit("!").cast("binary")))).otherwise(X.sha256_digest(F.col("content")))
    return tables.document_blobs(spark, folder).withColumn("digest", F.when(F.col("doc_id") % 11 != 0, claim))


@query(f"""WITH c AS (SELECT doc_id, text, {_CLAIM} AS digest FROM documents)
SELECT 'doc/' || doc_id AS name, CASE WHEN digest IS NULL THEN 'no_digest' WHEN digest = 'sha256:' || sha256(coalesce(text, '')) THEN 'ok' ELSE 'mismatch' END AS status FROM c""")
def verify_digest(spark, folder):
    return identity.verify(_claimed(spark, folder)).select("name", "status")


@query(f"""WITH c AS (SELECT source, text, {_CLAIM} AS digest FROM documents), s AS (SELECT source, CASE WHEN digest IS NULL THEN 'no_digest' WHEN digest = 'sha256:' || sha256(coalesce(text, '')) THEN 'ok' ELSE 'mismatch' END AS status FROM c)
SELECT source AS name, count(*) FILTER (WHERE status = 'ok') AS verified, count(*) FILTER (WHERE status = 'no_digest') AS undigested,
  CASE WHEN bool_or(status = 'mismatch') THEN 'mismatch' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'no_digest' END AS status FROM s GROUP BY source""")
def verify_objects(spark, folder):
    """Each source as one object whose parts are its documents."""
    got = identity.verify(_claimed(spark, folder)).select(F.col("source").alias("name"), "status")
    counts = got.groupBy("name").agg(F.count_if(F.col("status") == "ok").alias("verified"), F.count_if(F.col("status") == "no_digest").alias("undigested"))
    return counts.join(identity.verify_objects(counts.select("name"), got), "name")


@query("""WITH d AS (SELECT 'doc/' || doc_id AS name, sha256(coalesce(text, '')) AS h FROM documents)
SELECT name, min(name) OVER (PARTITION BY h) AS holder, count(*) OVER (PARTITION BY h) AS copies FROM d""")
def dedup_blobs(spark, folder):
    return identity.shared_blobs(tables.document_blobs(spark, folder)).select("name", "holder", "copies")


@query("""WITH d AS (SELECT 'doc/' || doc_id AS name, coalesce(text, '') AS t FROM documents), h AS (SELECT name, t, first_value(name) OVER (PARTITION BY sha256(t) ORDER BY name) AS holder FROM d)
SELECT h.name, 'data' AS part, h.holder FROM h JOIN d ON d.name = h.holder WHERE h.t <> d.t""")
def dedup_confirmed(spark, folder):
    """Shared blobs that differ from their holder byte by byte: none."""
    blobs = tables.document_blobs(spark, folder)
    return identity.unequal_shares(blobs, identity.shared_blobs(blobs))


@query("""WITH d AS (SELECT 'doc/' || doc_id AS name, coalesce(text, '') AS t FROM documents), h AS (SELECT *, octet_length(encode(t)) AS n FROM d),
f AS (SELECT n, min(name) AS holder FROM h GROUP BY n) SELECT h.name, 'data' AS part, f.holder FROM h JOIN f USING (n) JOIN h AS o ON o.name = f.holder WHERE h.t <> o.t""")
def dedup_refuted(spark, folder):
    """Blobs that a weak key, the length alone, would share with a holder of other content: the comparison tells them."""
    blobs = tables.document_blobs(spark, folder)
    holder = blobs.groupBy("length").agg(F.min("name").alias("holder"))
    return identity.unequal_shares(blobs, blobs.join(holder, "length").select("name", "part", "holder"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'doc/' || doc_id END AS name, NULL::VARCHAR AS part, 'Name' AS rule FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'doc/' || doc_id, repeat('p', 1025), 'Name' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0""")
def name_violations(spark, folder):
    """Objects without a name, and parts whose name is too long."""
    src = tables.read(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("name"))
    objects = src.select("name", F.array(F.lit(1).cast(U64)).alias("shape"), F.lit("dense").alias("layout"))
    part = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 5 != 0), F.repeat(F.lit("p"), 1025)).otherwise("data")
    parts = src.where("name <> ''").select("name", part.alias("part"), F.lit("u8").alias("dtype"), F.lit(None).cast("string").alias("logical"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("long").alias("decoded_length"), F.lit(1).cast("long").alias("length"))
    return catalog.metadata_violations(objects, parts)


@query("""WITH g AS (SELECT text, count(*) AS c, octet_length(encode(coalesce(text, ''))) AS n FROM documents GROUP BY text)
SELECT sum(c)::BIGINT AS blobs, count(*) AS distinct_blobs, sum(c * n)::BIGINT AS bytes, sum(n)::BIGINT AS distinct_bytes FROM g""")
def dedup_ratio(spark, folder):
    return identity.dedup_ratio(tables.document_blobs(spark, folder))


@query("""WITH p AS (SELECT source, 'doc/' || doc_id AS name, 'data' AS part, 'u8' AS dtype, '[' || octet_length(encode(coalesce(text, ''))) || ']' AS shape, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents),
a AS (SELECT source, name, sha256(string_agg(name || '|' || part || '|' || dtype || '|' || shape || '|' || digest, chr(10) ORDER BY octet_length(encode(part)), part)) AS h FROM p GROUP BY source, name),
b AS (SELECT source, octet_length(encode(name)) AS s, substr(name, 1, greatest(length(name) - 2, 1)) AS k, sha256(string_agg(name || '=' || h, chr(10) ORDER BY name)) AS h FROM a GROUP BY 1, 2, 3)
SELECT source, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY s, k)) AS content_digest FROM b GROUP BY source""")
def content_digest(spark, folder):
    src = identity.with_digests(tables.document_blobs(spark, folder))
    shape = F.concat(F.lit("["), F.col("length").cast("string"), F.lit("]"))
    return identity.content_digest(src.select("source", "name", "part", "dtype", shape.alias("shape"), "digest"), ["source"])


@query("""WITH w AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS h, min('doc/' || doc_id) AS path FROM documents GROUP BY 1, 2)
SELECT 's' || w.doc_id AS shard, f.path FROM w LEFT JOIN f USING (size, h)""")
def shard_resolve_by_identity(spark, folder):
    """Labelled documents as wanted shards, all documents as the files of a directory."""
    files = tables.document_blobs(spark, folder).select(F.col("name").alias("path"), F.col("length").alias("size"), "content", "doc_id")
    wanted = files.join(tables.read(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = wanted.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("shard"), "size", X.sha256_digest(F.col("content")).alias("digest"))
    return identity.resolve_shards(wanted, files.drop("doc_id"))


@query("""SELECT source AS shard, count(DISTINCT (octet_length(encode(coalesce(text, ''))), lang)) AS identities FROM documents GROUP BY source HAVING count(DISTINCT (octet_length(encode(coalesce(text, ''))), lang)) > 1""")
def shard_conflicts(spark, folder):
    src = tables.document_blobs(spark, folder, ()).select(F.col("source").alias("shard"), F.col("length").alias("size"), F.col("lang").alias("digest"))
    return identity.shard_conflicts(src)


@query("""SELECT 'ord/' || o_orderkey AS name, 'data' AS part, 'c' || o_custkey AS shard FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def missing_shards(spark, folder):
    """Orders as parts that refer to their customer's shard; only customers in credit have one."""
    shard = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("shard")
    parts = tables.read(spark, folder, "orders").select(F.concat(F.lit("ord/"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("data").alias("part"), shard("o_custkey"))
    return identity.missing_shards(parts, tables.read(spark, folder, "customer").where("c_acctbal > 0").select(shard("c_custkey")))


@query("""SELECT 'li/' || l_orderkey || '/' || l_linenumber AS name, 'data' AS part, 'p' || l_partkey AS shard FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber * 8 + l_quantity::BIGINT > p_size * 2""")
def out_of_bounds(spark, folder):
    """Line items as ranges of their part's file."""
    parts = tables.read(spark, folder, "lineitem").select(F.concat(F.lit("li/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("data").alias("part"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("shard"), (F.col("l_linenumber") * 8).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    files = tables.read(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("shard"), (F.col("p_size") * 2).alias("size"))
    return identity.out_of_bounds(parts, files)


# --- union, overlay, diff -----------------------------------------------------------------------------------------------------


@query("""SELECT 'emb/' || vec_id AS name, 0 AS store_id, 'f32' AS dtype FROM embeddings UNION ALL SELECT 'doc/' || doc_id, 1, 'u8' FROM documents UNION ALL SELECT 'page/' || page_id, 2, 'u8' FROM pages""")
def merge_sources(spark, folder):
    emb = tables.embedding_parts(spark, folder).select("name", "store_id", "dtype")
    docs = tables.document_blobs(spark, folder, ()).select("name", "store_id", "dtype")
    pages = tables.read(spark, folder, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("name"), F.lit(0).alias("store_id"), F.lit("u8").alias("dtype"))
    return catalog.merge([(emb, 1), (docs, 1), (pages, 1)])


@query("""SELECT 'doc/' || doc_id AS name, 2::BIGINT AS n_sources FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def merge_collisions(spark, folder):
    names = lambda t: tables.read(spark, folder, t).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"))
    return catalog.collisions([names("documents"), names("labels")])


@query("""SELECT 'doc/' || doc_id AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS length, 'base' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT 'doc/' || doc_id, 2::BIGINT, 'local' FROM labels""")
def overlay(spark, folder):
    base = tables.document_blobs(spark, folder, ()).select("name", "length")
    local = tables.read(spark, folder, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"), F.lit(2).cast("long").alias("length")).distinct()
    return catalog.overlay(base, local)


_SIDES = """l AS (SELECT doc_id, 'doc/' || doc_id AS name, '[' || length(coalesce(text, '')) || ']' AS shape, 'dense' AS layout, sha256(coalesce(text, '')) AS digest FROM documents WHERE source <> 'src1'),
r AS (SELECT doc_id, 'doc/' || doc_id AS name, '[' || (length(coalesce(text, '')) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)) || ']' AS shape, 'dense' AS layout, sha256(coalesce(text, '') || (CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END)) AS digest FROM documents WHERE source <> 'src2')"""


@query(f"""WITH {_SIDES} SELECT name, NULL AS part, 'removed' AS change FROM l WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT name, NULL, 'added' FROM r WHERE name NOT IN (SELECT name FROM l)
UNION ALL SELECT l.name, 'data', CASE WHEN l.shape <> r.shape THEN 'form' ELSE 'content' END FROM l JOIN r USING (name) WHERE l.shape <> r.shape OR l.digest <> r.digest""")
def diff(spark, folder):
    """Two versions of the documents: either lacks a source, some are reshaped, some changed."""
    src = tables.document_blobs(spark, folder).withColumn("n", F.length(F.col("content").cast("string")))

    def side(df, more, suffix):
        shape = F.concat(F.lit("["), (F.col("n") + more).cast("string"), F.lit("]")).alias("shape")
        return df.select("name", "part", shape, F.lit("dense").alias("layout"), F.sha2(F.concat("content", suffix.cast("binary")), 256).alias("digest"))

    k = F.col("doc_id")
    left = side(src.where("source <> 'src1'"), F.lit(0), F.lit(""))
    right = side(src.where("source <> 'src2'"), F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 3 == 0, F.lit("?")).otherwise(F.lit("")))
    return catalog.diff(left, right)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT 'u' || user_id AS name, event_type AS part, event_id AS generation, value FROM r WHERE k = 1""")
def generation_latest(spark, folder):
    """Events as appended generations of a user's parts."""
    src = tables.read(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("part"), F.col("event_id").alias("generation"), "value")
    return catalog.latest_generation(src)


@query("""SELECT 'doc/' || doc_id AS name, NULL AS part, 'Name' AS rule FROM documents WHERE false
UNION ALL SELECT 'emb/' || vec_id, NULL, 'Shape' FROM embeddings WHERE vec_id % 10 = 3
UNION ALL SELECT 'emb/' || vec_id, 'data', 'DenseSize' FROM embeddings WHERE vec_id % 10 = 4""")
def metadata_violations(spark, folder):
    """Vectors of which some claim an impossible shape and some one more dimension than they have bytes for."""
    k = F.substring_index("name", "/", -1).cast("long") % 10
    wrong = F.when(k == 3, F.array(F.lit(Decimal(2**63)).cast(U64), F.lit(4).cast(U64))).when(k == 4, F.concat("shape", F.array(F.lit(2).cast(U64)))).otherwise(F.col("shape"))
    objects = tables.embedding_objects(spark, folder).withColumn("shape", wrong)
    return catalog.metadata_violations(objects, tables.embedding_parts(spark, folder))


# --- layouts ------------------------------------------------------------------------------------------------------------------


@query("""SELECT l_suppkey AS "row", l_partkey AS col, 'duplicate' AS rule FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT l_suppkey, l_partkey, 'range' FROM lineitem WHERE l_suppkey > 90 OR l_partkey > 1900""")
def coo_validate(spark, folder):
    return profiles.coo_faults(tables.cells(spark, folder), 91, 1901)


_CSR = """c AS (SELECT l_suppkey AS "row", l_partkey AS col, sum(l_quantity)::BIGINT AS value FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_CSR} SELECT "row", row_number() OVER (ORDER BY "row", col) - 1 AS pos, col, value FROM c""")
def coo_to_csr(spark, folder):
    return profiles.coo_to_csr(tables.cells(spark, folder))


@query("""WITH o AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY pos) AS p FROM o)
SELECT l_suppkey AS "row", count(*) AS faults FROM w WHERE l_partkey > 1999 OR p >= l_partkey GROUP BY l_suppkey""")
def csr_validate(spark, folder):
    """Line items in the order they came as the rows of suppliers: their columns don't increase."""
    li = tables.read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("row"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).agg(F.min("l_partkey").alias("col"))
    return profiles.csr_faults(li, 2000).groupBy("row").agg(F.count(F.lit(1)).alias("faults"))


@query(f"""WITH {_CSR}, n AS (SELECT "row", count(*) AS length FROM c GROUP BY 1) SELECT "row", (coalesce(sum(length) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, length FROM n""")
def csr_row_lengths(spark, folder):
    return profiles.row_pointers(tables.cells(spark, folder).select("row", "col").distinct())


@query("""SELECT l_suppkey AS "row", sum(l_quantity::BIGINT * p_size)::BIGINT AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def csr_spmv(spark, folder):
    return profiles.spmv(tables.cells(spark, folder), tables.read(spark, folder, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").alias("x")))


_BYTES = """o AS (SELECT 'ord/' || l_orderkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_quantity::INT AS b, round(l_tax * 100)::INT AS tax, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


@query(f"""WITH {_BYTES}, h AS (SELECT name, pos * 2 AS idx, b & 15 AS c FROM o UNION ALL SELECT name, pos * 2 + 1, (b >> 4) & 15 FROM o)
SELECT name, idx, (CASE WHEN c & 8 = 0 THEN 1.0 ELSE -1.0 END * CASE WHEN (c >> 1) & 3 = 0 THEN (c & 1) * 0.5 ELSE pow(2.0, ((c >> 1) & 3) - 1) * (1 + (c & 1) * 0.5) END)::DOUBLE + 0.0::DOUBLE AS value FROM h""")
def f4_unpack(spark, folder):
    got = profiles.unpack_f4(tables.order_bytes(spark, folder), ["name"])
    return got.withColumn("value", F.col("value") + F.lit(0.0))


@query(f"""WITH {_BYTES} SELECT name, count(*) FILTER (WHERE tax > 1) AS bad FROM o GROUP BY name HAVING count(*) FILTER (WHERE tax > 1) > 0""")
def bool_check(spark, folder):
    return profiles.bool_faults(tables.order_bytes(spark, folder).select("name", F.col("tax").alias("byte")), "name")


@query(f"""WITH {_BYTES} SELECT name, pos, b AS byte FROM o WHERE n % 2 = 1 AND pos = (n - 1) // 2 AND (b >> 4) & 15 <> 0""")
def f4_odd_tail(spark, folder):
    return profiles.odd_tail_faults(tables.order_bytes(spark, folder), "name").select("name", "pos", "byte")


_VALUES = """v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings), x AS (SELECT *, idx // 32 AS g FROM v),
r AS (SELECT vec_id, g, min(value) AS lo, max(value) AS hi FROM x GROUP BY 1, 2), s AS (SELECT vec_id, g, lo, CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1.0 END AS scale FROM r),
q AS (SELECT x.vec_id, idx, g, scale, floor(-lo / scale + 0.5)::BIGINT AS zero, least(greatest(floor(value / scale + 0.5)::BIGINT + floor(-lo / scale + 0.5)::BIGINT, 0), 255) AS q FROM x JOIN s USING (vec_id, g))"""


def _quantized(spark, folder):
    values = tables.read(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "value"))
    values = values.select("vec_id", F.col("idx").cast("long").alias("idx"), F.floor(F.col("idx") / 32).alias("g"), F.col("value").cast("double").alias("value"))
    return profiles.quantize_groups(values, ["vec_id"])


@query(f"WITH {_VALUES} SELECT vec_id, idx, q, zero, round(scale, 9) AS scale FROM q")
def quant_group_quantize(spark, folder):
    return _quantized(spark, folder).select("vec_id", "idx", "q", "zero", F.round("scale", 9).alias("scale"))


@query(f"WITH {_VALUES} SELECT vec_id, idx, round((q - zero) * scale, 6) + 0.0::DOUBLE AS value FROM q")
def quant_group_dequantize(spark, folder):
    codes = _quantized(spark, folder)
    scales = codes.select("vec_id", "g", "scale", "zero").distinct()
    got = profiles.dequantize_groups(codes.select("vec_id", "idx", "g", "q"), scales, ["vec_id"])
    return got.select("vec_id", "idx", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("""SELECT 'ord/' || l_orderkey AS name, l_linenumber AS idx, l_partkey, l_suppkey, l_quantity, CASE WHEN l_suppkey % 256 = 255 THEN NULL ELSE pow(2.0, l_suppkey % 256 - 127) * l_quantity END AS value FROM lineitem""")
def mx_scale(spark, folder):
    """Quantities scaled by a power of two; the code for no number is shown as null."""
    value = X.e8m0_value(F.col("l_suppkey") % 256) * F.col("l_quantity")
    return tables.read(spark, folder, "lineitem").select(F.concat(F.lit("ord/"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_linenumber").alias("idx"), "l_partkey", "l_suppkey", "l_quantity", F.when(~F.isnan(value), value).alias("value"))


@query("""SELECT event_id, event_id * 2654435761 % 4294967296 & 15 AS first, (event_id * 2654435761 % 4294967296 >> 28) & 15 AS last FROM events""")
def unpack_words(spark, folder):
    """The lowest and highest of the eight 4-bit codes in a word for each event."""
    words = tables.read(spark, folder, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 2654435761 % 4294967296).alias("word"))
    got = profiles.unpack_words(words, 4)
    at = F.floor(F.col("idx") / 8)
    return got.groupBy(at.alias("event_id")).agg(F.max(F.when(F.col("idx") % 8 == 0, F.col("q"))).alias("first"), F.max(F.when(F.col("idx") % 8 == 7, F.col("q"))).alias("last"))


@query("""SELECT 'emb/' || vec_id AS name, count(*) AS n, round(sum(x), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def decode_elements(spark, folder):
    """Vectors as f32 parts, decoded from their bytes."""
    src = tables.read(spark, folder, "embeddings")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            raw = [np.array(x, dtype="<f4").tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"emb/{i}" for i in b.column("vec_id").to_pylist()]), pa.array(raw, pa.binary())], names=["name", "content"])

    parts = src.mapInArrow(run, "name string, content binary").select("name", F.lit("data").alias("part"), F.lit("f32").alias("dtype"), "content")
    return profiles.decode_elements(parts).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))


# --- streams ------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, event_id, (event_id % 5 + 1) AS length FROM events), u AS (SELECT user_id, sum(length)::BIGINT AS written, 60::BIGINT AS declared FROM c GROUP BY user_id)
SELECT 'u' || user_id AS name, declared, written, CASE WHEN written > declared THEN 'overrun' WHEN written = declared THEN 'complete' ELSE 'short' END AS status FROM u""")
def stream_chunk_completion(spark, folder):
    from ..streaming import chunks

    src = tables.read(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.lit("data").alias("part"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 + 1).alias("length"), F.lit(60).cast("long").alias("declared"))
    return chunks.completion(src).select("name", "declared", "written", "status")
