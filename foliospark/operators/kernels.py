"""Relational kernels of the document operators, over the driver's tables, each with the SQL that it must equal.

The tables stand in for tables of documents: they show that an operator's plan is right, not that PDFs are handled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.plans import tools

from . import relational as R

#: name -> (query, equal SQL)
KERNELS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def kernel(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        KERNELS[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Three encodings of a text stand for three filter pipelines of a stream; the class is its decoded content.
@kernel("""
WITH enc AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest,
         CASE doc_id % 3 WHEN 0 THEN 2 * octet_length(encode(coalesce(text, '')))
              WHEN 1 THEN 4 * ((octet_length(encode(coalesce(text, ''))) + 2) // 3)
              ELSE octet_length(encode(coalesce(text, ''))) END AS stored
  FROM documents)
SELECT digest, count(*) AS copies, arg_min(doc_id, {'s': stored, 'd': doc_id}) AS kept,
       CAST(min(stored) AS BIGINT) AS kept_bytes, CAST(sum(stored) - min(stored) AS BIGINT) AS saved_bytes
FROM enc GROUP BY digest HAVING count(*) > 1""")
def dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    coded = F.when(F.col("doc_id") % 3 == 0, F.encode(F.hex(raw), "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(F.regexp_replace(F.base64(raw), "\\s", ""), "UTF-8")).otherwise(raw)
    streams = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("filter"), coded.alias("raw"))
    text = F.decode("raw", "UTF-8")
    plain = F.when(F.col("filter") == 0, F.unhex(text)).when(F.col("filter") == 1, F.unbase64(text)).otherwise(F.col("raw"))
    return (
        streams.select("doc_id", F.sha2(plain, 256).alias("digest"), F.octet_length("raw").cast("long").alias("stored"))
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct("stored", "doc_id")).alias("kept"), F.min("stored").alias("kept_bytes"), (F.sum("stored") - F.min("stored")).alias("saved_bytes"))
        .where("copies > 1")
    )


@kernel("SELECT sha256(coalesce(text, '')) AS digest, coalesce(source, '') AS key, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce("source", F.lit("")).alias("key"))
    return keyed.groupBy("digest", "key").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@kernel("""
WITH RECURSIVE edges AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 5) FROM region),
seen(root, node) AS (SELECT c_custkey, 'c' || c_custkey FROM customer UNION SELECT s.root, e.dst FROM seen s JOIN edges e ON e.src = s.node)
SELECT root, node FROM seen""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        read(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
        .union(read(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(read(spark, sf_dir, "region").select(name("r", "r_regionkey"), F.concat(F.lit("n"), (F.col("r_regionkey") * 5).cast("string"))))
    )
    roots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), name("c", "c_custkey").alias("node"))
    return R.reachable(edges, roots, ["root"])


@kernel("""
SELECT l_orderkey, arg_min(codec, {'s': size, 'r': rank}) AS codec, min(size) AS size FROM (
  SELECT l_orderkey, l_linenumber % 3 AS rank, CAST(l_quantity AS BIGINT) // 4 AS size, l_shipmode_ AS codec FROM (
    SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'flate' ELSE 'jpeg' END AS l_shipmode_ FROM lineitem)) GROUP BY l_orderkey""")
def argmin_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = (F.col("l_linenumber") % 3).cast("long")
    codec = F.when(rank == 0, "png").when(rank == 1, "flate").otherwise("jpeg")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", rank.alias("rank"), F.floor(F.col("l_quantity").cast("long") / 4).alias("size"), codec.alias("codec"))
    return R.smallest(rows, ["l_orderkey"], "size", "rank", "codec").select("l_orderkey", "codec", "size")


KEEP = "saved >= 16 AND saved >= (n_chars + 49) // 50"


@kernel(f"SELECT doc_id, saved, ({KEEP}) AS keep FROM (SELECT doc_id, n_chars, n_chars % 100 AS saved FROM documents)")
def keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 100).alias("saved"))
    return rows.select("doc_id", "saved", F.expr("saved >= 16 and saved >= (n_chars + 49) div 50").alias("keep"))


@kernel("""
SELECT l_partkey, min(l_linenumber) AS u0, min(l_suppkey) AS v0, max(l_linenumber + CAST(l_quantity AS BIGINT)) AS u1, max(l_suppkey + 3) AS v1,
       min(CAST(l_extendedprice AS BIGINT)) AS dpi_x, min(CAST(l_quantity AS BIGINT)) AS dpi_y FROM (SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem) GROUP BY l_partkey""")
def rect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.round(c).cast("long")
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").cast("long").alias("u0"), F.col("l_suppkey").alias("v0"), (F.col("l_linenumber") + whole("l_quantity")).alias("u1"), (F.col("l_suppkey") + 3).alias("v1"), F.rint("l_extendedprice").cast("long").alias("dpi_x"), whole("l_quantity").alias("dpi_y"))
    return R.bounds(rows, "l_partkey")


@kernel("SELECT event_type, batch, count(*) AS files FROM (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32 AS batch FROM events) GROUP BY 1, 2")
def batch32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(read(spark, sf_dir, "events"), ["event_type"], ["event_id"], 32).groupBy("event_type", "batch").agg(F.count("*").alias("files"))


@kernel("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@kernel("SELECT o_orderkey, o_custkey + 500 AS target FROM orders WHERE o_custkey + 500 NOT IN (SELECT c_custkey FROM customer)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 500).alias("target"))
    return R.dangling(edges, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")), ["target"]).select("o_orderkey", "target")


@kernel("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS soft_mask FROM part")
def semi_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("soft_mask", F.lit(True))
    return read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("soft_mask", F.lit(False)).alias("soft_mask"))


@kernel("SELECT s_suppkey, coalesce(n, 0) AS parents FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON s_suppkey = l_suppkey")
def mask_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("parents"))


@kernel("""
SELECT reason, count(*) AS images, CAST(sum(raw) AS BIGINT) AS bytes FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'image mask' WHEN p_partkey % 7 = 0 THEN 'mask entry' WHEN p_size <= 2 THEN 'invalid dimensions'
  WHEN p_partkey % 5 NOT IN (1, 2, 3) THEN (p_partkey % 5) || '-bit' WHEN p_brand LIKE '%5' THEN 'color space' WHEN CAST(p_retailprice AS BIGINT) < 1024 THEN 'no gain' ELSE '' END AS reason, CAST(p_retailprice AS BIGINT) AS raw FROM part) GROUP BY reason""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.rint("p_retailprice").cast("long")
    rules = [
        (F.col("p_partkey") % 11 == 0, "image mask"), (F.col("p_partkey") % 7 == 0, "mask entry"), (F.col("p_size") <= 2, "invalid dimensions"),
        (F.col("p_partkey") % 5 == 0, "0-bit"), (F.col("p_partkey") % 5 == 4, "4-bit"), (F.col("p_brand").endswith("5"), "color space"), (raw < 1024, "no gain"),
    ]
    return read(spark, sf_dir, "part").select(R.first_reason(rules).alias("reason"), raw.alias("raw")).groupBy("reason").agg(F.count("*").alias("images"), F.sum("raw").alias("bytes"))


@kernel("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN n_name END, r_name, 'default') AS value
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where("r_regionkey < 3")
    rows = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")), "r_name", F.lit("default")).alias("value"))


@kernel("SELECT doc_id, CASE n WHEN 0 THEN source ELSE source || '.' || n END AS output FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def number_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "output")


@kernel("""
SELECT event_id, CASE WHEN flavour = '' THEN 'publish' WHEN out = 'compliant' THEN 'publish' WHEN converted THEN 'error' WHEN out = 'missing' THEN 'warn' WHEN out = 'failed' THEN 'error'
  WHEN inp = 'rejected' THEN 'warn' ELSE 'error' END AS decision
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE '2b' END AS flavour, event_id % 2 = 0 AS converted, CASE event_id % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' ELSE 'missing' END AS out,
  CASE event_id % 3 WHEN 0 THEN 'compliant' WHEN 1 THEN 'rejected' ELSE 'failed' END AS inp FROM events)""")
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    out = F.when(e % 4 == 0, "compliant").when(e % 4 == 1, "rejected").when(e % 4 == 2, "failed").otherwise("missing")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, "").otherwise("2b").alias("flavour"), (e % 2 == 0).alias("converted"), out.alias("out"), F.when(e % 3 == 0, "compliant").when(e % 3 == 1, "rejected").otherwise("failed").alias("inp"))
    return rows.select("event_id", tools.decision(F.col("flavour"), F.col("converted"), F.col("out"), F.col("inp")).alias("decision"))


_CLAUSE = "CASE " + " ".join(f"WHEN clause = '{p}' OR starts_with(clause, '{p}.') THEN '{c}'" for p, c in tools.CLAUSES) + " ELSE 'other' END"


@kernel(f"SELECT category, count(*) AS failures FROM (SELECT {_CLAUSE} AS category FROM (SELECT (5 + p_partkey % 2) || '.' || (p_size % 11) || '.' || (p_partkey % 13) AS clause FROM part)) GROUP BY category")
def clause_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    clause = F.concat_ws(".", text(5 + F.col("p_partkey") % 2), text(F.col("p_size") % 11), text(F.col("p_partkey") % 13))
    rows = read(spark, sf_dir, "part").select(clause.alias("clause"))
    return rows.groupBy(tools.category(F.col("clause")).alias("category")).agg(F.count("*").alias("failures"))


@kernel("SELECT event_type AS outcome, user_id % 4 AS detail, count(*) AS files FROM events GROUP BY 1, 2")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("outcome"), (F.col("user_id") % 4).alias("detail")).agg(F.count("*").alias("files"))


@kernel("SELECT o_orderkey, ((o_custkey % 1024) | 4) & ~(1 | 256) AS flags FROM orders")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1024).bitwiseOR(4).bitwiseAND(~(1 | 256)).alias("flags"))


@kernel("SELECT l_orderkey, l_linenumber, num, (num - 1) // 100 AS pack FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS num FROM lineitem)")
def renumber_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = read(spark, sf_dir, "lineitem").withColumn("num", F.row_number().over(w).cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "num", F.floor((F.col("num") - 1) / 100).alias("pack"))


@kernel("SELECT name, count(*) AS programs, count(DISTINCT p_type) AS types FROM (SELECT regexp_replace(upper(substr(sha256(p_type), 1, 1)) || 'ABCDE+' || p_brand, '^[A-Z]{6}\\+', '') AS name, p_type FROM part) GROUP BY name HAVING count(DISTINCT p_type) > 1")
def subset_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.concat(F.upper(F.substring(F.sha2("p_type", 256), 1, 1)), F.lit("ABCDE+"), "p_brand")
    rows = read(spark, sf_dir, "part").select(F.regexp_replace(tagged, "^[A-Z]{6}\\+", "").alias("name"), "p_type")
    return rows.groupBy("name").agg(F.count("*").alias("programs"), F.count_distinct("p_type").alias("types")).where("types > 1")


@kernel("SELECT doc_id, sha256(unhex(digits || CASE WHEN length(digits) % 2 = 1 THEN '0' ELSE '' END)) AS digest FROM (SELECT doc_id, left(digits, CAST(length(digits) - (doc_id % 2) AS BIGINT)) AS digits FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents))")
def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    odd = F.left(whole, (F.length(whole) - F.col("doc_id") % 2).cast("int"))  # every other text lacks its last digit
    broken = F.regexp_replace(odd, "(.{16})", "$1 \n")
    digits = F.regexp_replace(F.split_part(F.concat(broken, F.lit(">junk")), F.lit(">"), F.lit(1)), "[\\s\\x00]", "")
    padded = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.unhex(padded), 256).alias("digest"))


@kernel("""
SELECT o_orderkey, CASE WHEN after = before THEN 'no reduction' WHEN after > before THEN before || ' -> ' || after || ' larger' ELSE before || ' -> ' || after || ' smaller' END AS line,
  CAST(round_even(1000 * CAST(before - after AS DOUBLE) / before, 0) AS BIGINT) AS permille FROM (SELECT o_orderkey, o_custkey + 1000 AS before, o_orderkey % 2000 + 1 AS after FROM orders)""")
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 1000).alias("before"), (F.col("o_orderkey") % 2000 + 1).alias("after"))
    sizes = lambda word: F.concat(F.col("before").cast("string"), F.lit(" -> "), F.col("after").cast("string"), F.lit(f" {word}"))
    line = F.when(F.col("after") == F.col("before"), "no reduction").when(F.col("after") > F.col("before"), sizes("larger")).otherwise(sizes("smaller"))
    return rows.select("o_orderkey", line.alias("line"), F.rint(1000 * (F.col("before") - F.col("after")).cast("double") / F.col("before")).cast("long").alias("permille"))


@kernel("SELECT doc_id, list_filter([doc_id % 3, doc_id % 5, doc_id % 7], lambda x: NOT x IN (1, 2)) AS kept, CASE doc_id % 3 WHEN 1 THEN 'forms' WHEN 2 THEN 'links' ELSE 'annotations' END AS category FROM documents")
def annotation_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    category = F.when(d % 3 == 1, "forms").when(d % 3 == 2, "links").otherwise("annotations")
    return read(spark, sf_dir, "documents").select("doc_id", F.filter(F.array(d % 3, d % 5, d % 7), lambda x: ~x.isin(1, 2)).alias("kept"), category.alias("category"))


@kernel("SELECT doc_id, starts_with(coalesce(text, ''), 'The ') AS magic FROM documents")
def magic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", (F.substring(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 1, 4) == F.lit(bytearray(b"The "))).alias("magic"))


@kernel("SELECT p_partkey, regexp_matches(name, '(?i)\\.out(\\.[0-9]+)?\\.pdf$') AND TRY_CAST(coalesce(nullif(regexp_extract(name, '(?i)\\.out\\.([0-9]+)\\.pdf$', 1), ''), '0') AS BIGINT) <= 4294967295 AS own FROM (SELECT p_partkey, p_brand || CASE p_partkey % 4 WHEN 0 THEN '.OUT.pdf' WHEN 1 THEN '.out.' || (p_partkey * 4000000) || '.PDF' WHEN 2 THEN '.out.x.pdf' ELSE '.pdf' END AS name FROM part)")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    ending = F.when(p % 4 == 0, ".OUT.pdf").when(p % 4 == 1, F.concat(F.lit(".out."), (p * 4_000_000).cast("string"), F.lit(".PDF"))).when(p % 4 == 2, ".out.x.pdf").otherwise(".pdf")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", ending).alias("name"))
    number = F.coalesce(F.nullif(F.regexp_extract("name", r"(?i)\.out\.([0-9]+)\.pdf$", 1), F.lit("")), F.lit("0")).try_cast("long")
    return rows.select("p_partkey", (F.col("name").rlike(r"(?i)\.out(\.[0-9]+)?\.pdf$") & (number <= 4294967295)).alias("own"))


@kernel("SELECT user_id, min(event_id) AS ordinal FROM events GROUP BY user_id")
def distinct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("event_id").alias("ordinal"))


_FLAVOURS = ["1a", "1b", "2a", "2b", "2u", "3a", "3b", "3u", "4", "4e", "4f"]


@kernel(f"SELECT p_partkey, CASE WHEN part = 0 THEN '' WHEN part || conf IN ({', '.join(repr(f) for f in _FLAVOURS)}) THEN part || conf ELSE 'error' END AS flavour FROM (SELECT p_partkey, p_partkey % 6 AS part, CASE p_size % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'u' WHEN 3 THEN 'e' WHEN 4 THEN 'f' ELSE '' END AS conf FROM part)")
def declared_flavour(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.element_at(F.array(*map(F.lit, ["a", "b", "u", "e", "f", ""])), F.col("p_size") % 6 + 1)
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("part"), conf.alias("conf"))
    name = F.concat(F.col("part").cast("string"), "conf")
    return rows.select("p_partkey", F.when(F.col("part") == 0, "").when(name.isin(_FLAVOURS), name).otherwise("error").alias("flavour"))


@kernel("SELECT p_partkey, CASE WHEN major NOT BETWEEN 1 AND 2 OR minor > 9 THEN '1.7' WHEN major = 1 AND minor < 5 THEN '1.5' ELSE major || '.' || minor END AS version FROM (SELECT p_partkey, p_partkey % 4 AS major, p_size % 12 AS minor FROM part)")
def header_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", (F.col("p_partkey") % 4).cast("string"), (F.col("p_size") % 12).cast("string")).alias("v"))
    major, minor = F.split_part("v", F.lit("."), F.lit(1)).cast("int"), F.split_part("v", F.lit("."), F.lit(2)).cast("int")
    return rows.select("p_partkey", F.when(~major.between(1, 2) | (minor > 9), "1.7").when((major == 1) & (minor < 5), "1.5").otherwise(F.col("v")).alias("version"))


@kernel("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR (c_nationkey IS NULL AND c_acctbal > 0)")
def xmp_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    xmp = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' or c_nationkey is null and c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(xmp, "o_custkey", "left_semi").select("o_orderkey")


_ANCESTORS = "SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 3 END AS parent, CASE WHEN c_custkey % 10 = 0 THEN c_custkey END AS value FROM customer"


@kernel(f"""
WITH RECURSIVE nodes AS ({_ANCESTORS}), up AS (SELECT id, parent, value, 0 AS depth FROM nodes
  UNION ALL SELECT up.id, n.parent, n.value, depth + 1 FROM up JOIN nodes n ON n.id = up.parent WHERE up.value IS NULL AND depth < 63)
SELECT id, max(value) AS value FROM up GROUP BY id""")
def inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    nodes = read(spark, sf_dir, "customer").select(c.alias("id"), F.when(c > 1, F.floor(c / 3)).alias("parent"), F.when(c % 10 == 0, c).alias("value"))
    return R.nearest(nodes)


@kernel("""
WITH RECURSIVE links AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey + 1 END AS next, CASE WHEN c_custkey % 8 = 0 THEN c_custkey * 10 END AS value FROM customer),
walk AS (SELECT id, next, value, 1 AS hop FROM links UNION ALL SELECT w.id, l.next, l.value, hop + 1 FROM walk w JOIN links l ON l.id = w.next WHERE hop < 32)
SELECT id, max(value) AS value FROM walk GROUP BY id""")
def deref_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    links = read(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 8 != 0, c + 1).alias("next"), F.when(c % 8 == 0, c * 10).alias("value"))
    return R.follow(links, links.select("id"))


@kernel("SELECT p_partkey, w, h, CASE WHEN w > 2147483648 // (c * b) THEN NULL WHEN h > 268435456 // ((w * c * b + 7) // 8) THEN NULL ELSE (w * c * b + 7) // 8 * h END AS bytes FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * 1000 + 1 AS w, CAST(p_partkey AS BIGINT) * 7 + 1 AS h, 1 + p_partkey % 4 AS c, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 16 END AS b FROM part)")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * F.col("p_size") * 1000 + 1).alias("w"), (p * 7 + 1).alias("h"), (1 + p % 4).alias("c"), F.when(p % 3 == 0, 1).when(p % 3 == 1, 8).otherwise(16).cast("long").alias("b"))
    bytes_ = F.expr("if(w > 2147483648 div (c * b), null, if(h > 268435456 div ((w * c * b + 7) div 8), null, (w * c * b + 7) div 8 * h))")
    return rows.select("p_partkey", "w", "h", bytes_.alias("bytes"))


@kernel("SELECT o_orderkey, CASE WHEN size >= 1000 AND o_custkey % 4 <> 0 THEN 1000 ELSE size END AS after, size >= 1000 AND o_custkey % 4 <> 0 AS copied FROM (SELECT o_orderkey, o_custkey, o_orderkey % 2000 AS size FROM orders)")
def size_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("o_orderkey") % 2000
    copied = (size >= 1000) & (F.col("o_custkey") % 4 != 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(copied, 1000).otherwise(size).cast("long").alias("after"), copied.alias("copied"))


@kernel("SELECT p_partkey FROM part WHERE p_size % 5 NOT IN (0, 1) AND p_partkey % 3 <> 0 AND NOT (p_size = 7 AND p_partkey % 2 = 0)")
def missing_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    exempt, has, flat = (F.col("p_size") % 5).isin(0, 1), F.col("p_partkey") % 3 == 0, (F.col("p_size") == 7) & (F.col("p_partkey") % 2 == 0)
    return read(spark, sf_dir, "part").where(~exempt & ~has & ~flat).select("p_partkey")


@kernel("SELECT p_partkey, CASE n WHEN 1 THEN p_type ELSE p_type || ' ' || n END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", n.cast("string"))).alias("name"))


@kernel("SELECT n_regionkey, list_sort(list_filter(list(n_nationkey), lambda x: x % 3 <> 0)) AS missing FROM nation GROUP BY n_regionkey")
def complete_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_set("n_nationkey").alias("all"))
    return sets.select("n_regionkey", F.array_sort(F.array_except("all", F.filter("all", lambda x: x % 3 == 0))).alias("missing"))


@kernel("SELECT o_orderkey, coalesce(CASE WHEN c_custkey IS NULL THEN NULL ELSE c_mktsegment END, 'did not report') AS verdict FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return read(spark, sf_dir, "orders").join(said, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("did not report")).alias("verdict"))


@kernel("SELECT DISTINCT k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT n_nationkey FROM nation)")
def file_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [read(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"))]
    return named[0].union(named[1]).union(named[2]).dropDuplicates(["k"])


@kernel("SELECT o_orderkey, job FROM orders JOIN (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS job FROM orders GROUP BY 1, 2) USING (o_orderpriority, o_orderstatus)")
def alias_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_orderpriority", "o_orderstatus"]
    orders = read(spark, sf_dir, "orders").select("o_orderkey", *keys)
    return orders.join(orders.groupBy(*keys).agg(F.min("o_orderkey").alias("job")), keys).select("o_orderkey", "job")


@kernel("SELECT l_returnflag, count(*) AS seen, count(*) FILTER (l_linenumber > 2) AS changed, CAST(sum(l_partkey) AS BIGINT) AS before, CAST(sum(CASE WHEN l_linenumber > 2 THEN l_partkey // 2 ELSE l_partkey END) AS BIGINT) AS after FROM lineitem GROUP BY l_returnflag")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.col("l_linenumber") > 2
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("seen"), F.count_if(changed).alias("changed"), F.sum("l_partkey").alias("before"), F.sum(F.when(changed, F.floor(F.col("l_partkey") / 2)).otherwise(F.col("l_partkey"))).alias("after"))


@kernel("SELECT l_suppkey, CASE WHEN bool_or(l_quantity = 50 AND l_linenumber = 7) THEN NULL ELSE list_sort(list(DISTINCT l_linenumber)) END AS codes, bool_or(l_quantity = 50 AND l_linenumber = 7) AS unknown FROM lineitem GROUP BY l_suppkey")
def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uses(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_linenumber"), (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7))


@kernel("SELECT s_nationkey, list_sort(list(DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'rgb' ELSE 'cmyk' END)) AS families FROM supplier GROUP BY s_nationkey")
def color_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.element_at(F.array(F.lit("gray"), F.lit("rgb"), F.lit("cmyk")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(family)).alias("families"))


@kernel("SELECT user_id, string_agg(event_type, chr(10) ORDER BY event_id) AS message, bool_or(event_type = 'error') AS canceled FROM events GROUP BY user_id")
def error_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(parts, "\n").alias("message"), F.bool_or(F.col("event_type") == "error").alias("canceled"))


@kernel("SELECT p_brand AS kind, CAST(sum(p_size) AS BIGINT) AS repairs FROM part GROUP BY p_brand")
def repair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.sum("p_size").alias("repairs"))


@kernel("SELECT p_partkey, CASE WHEN f < p_size * 3 AND 2 * f <= 7 * d THEN 'full' ELSE 'downsampled' END AS choice FROM (SELECT p_partkey, p_size, p_partkey % 100 AS f, p_partkey % 37 AS d FROM part)")
def bitonal_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, down = F.col("p_partkey") % 100, F.col("p_partkey") % 37
    return read(spark, sf_dir, "part").select("p_partkey", F.when((full < F.col("p_size") * 3) & (full <= 3.5 * down), "full").otherwise("downsampled").alias("choice"))


@kernel("SELECT p_partkey, CASE WHEN least(a, b) < p_size OR p_partkey % 9 = 0 THEN CASE WHEN a <= b THEN 'flate' ELSE 'jpeg' END ELSE 'kept' END AS outcome FROM (SELECT p_partkey, p_size, p_partkey % 31 AS a, p_partkey % 29 AS b FROM part)")
def advanced_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.inline(F.array(F.struct((p % 31).alias("size"), F.lit(0).alias("rank"), F.lit("flate").alias("codec")), F.struct((p % 29).alias("size"), F.lit(1).alias("rank"), F.lit("jpeg").alias("codec")))))
    best = R.smallest(rows, ["p_partkey", "p_size"], "size", "rank", "codec")
    return best.select("p_partkey", F.when((F.col("size") < F.col("p_size")) | (p % 9 == 0), F.col("codec")).otherwise("kept").alias("outcome"))


@kernel("SELECT p_partkey, CAST(floor(x) AS BIGINT) - 1 AS x0, CAST(ceil(x + w) AS BIGINT) + 1 AS x1, CAST(round_even(w / 2, 0) AS BIGINT) AS half FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS x, CAST(p_partkey AS DOUBLE) AS w FROM part)")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(4.0)).alias("x"), F.col("p_partkey").cast("double").alias("w"))
    return rows.select("p_partkey", (F.floor("x") - 1).alias("x0"), (F.ceil(F.col("x") + F.col("w")) + 1).alias("x1"), F.rint(F.col("w") / 2).cast("long").alias("half"))


@kernel("SELECT o_orderkey, try_strptime(stamp, '%Y%m%d%H%M%S') IS NOT NULL AS valid FROM (SELECT o_orderkey, '20' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') || '101010' AS stamp FROM orders)")
def date_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c, n: F.lpad((F.col(c) % n).cast("string"), 2, "0")
    stamp = F.concat(F.lit("20"), two("o_orderkey", 30), two("o_custkey", 14), two("o_orderkey", 33), F.lit("101010"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).isNotNull().alias("valid"))


@kernel("SELECT p_partkey, list_aggregate([p_size, p_size, p_partkey % 51], 'min') = list_aggregate([p_size, p_size, p_partkey % 51], 'max') AS gray, p_size IN (0, 25) AND p_partkey % 51 IN (0, 25) AS bilevel FROM part")
def gray_and_bilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long"), F.col("p_partkey") % 51)
    return read(spark, sf_dir, "part").select("p_partkey", F.forall(samples, lambda x: x == samples[0]).alias("gray"), F.forall(samples, lambda x: x.isin(0, 25)).alias("bilevel"))


@kernel("SELECT doc_id, sha256(encode(length(source) || ':' || source || octet_length(encode(coalesce(text, ''))) || ':' || coalesce(text, ''))) AS digest FROM documents")
def prefixed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    framed = F.concat(F.length("source").cast("string"), F.lit(":"), "source", F.octet_length(text).cast("string"), F.lit(":"), text)
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(framed, 256).alias("digest"))


@kernel("SELECT p_partkey, parse_filename(path) AS base, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, regexp_replace(path, '/[^/]*$', '') AS dir FROM (SELECT p_partkey, '/in/' || p_brand || '/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.tar.gz' WHEN p_partkey % 3 = 1 THEN '.PDF' ELSE '' END AS path FROM part)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    path = F.concat(F.lit("/in/"), "p_brand", F.lit("/"), p.cast("string"), F.when(p % 3 == 0, ".tar.gz").when(p % 3 == 1, ".PDF").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select("p_partkey", F.substring_index("path", "/", -1).alias("base"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"))


@kernel("SELECT l_orderkey, l_linenumber, a * 2 + b * 3 + 5 AS x, a * 4 - b + 7 AS y, 2 * -1 - 3 * 4 AS det FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS a, l_partkey AS b FROM lineitem)")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber").cast("long"), F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (a * 2 + b * 3 + 5).alias("x"), (a * 4 - b + 7).alias("y"), F.lit(2 * -1 - 3 * 4).alias("det"))


@kernel("SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS ordinal FROM events")
def input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordinals(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@kernel("SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r?\\n$', ''), chr(10)), lambda l: source || '/' || doc_id || '.pdf: ' || regexp_replace(l, '\\r$', '')), chr(10)) AS lines FROM documents")
def prefixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return read(spark, sf_dir, "documents").select("doc_id", tools.prefixed(path, F.coalesce("text", F.lit(""))).alias("lines"))


@kernel("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def signed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")).select("o_custkey").distinct()


@kernel("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linestatus NOT IN ('O', 'F') OR l_returnflag = 'A')")
def forbidden_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read(spark, sf_dir, "lineitem").withColumn("bad", ~F.col("l_linestatus").isin("O", "F") | (F.col("l_returnflag") == "A"))
    return allowed.groupBy("l_orderkey").agg(F.bool_or("bad").alias("bad")).where("bad").select("l_orderkey")
