"""The function library over whole tables: strings, lists, tags, numbers, dates, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, dates, lists, numbers, strings, tags


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def string_functions(spark, sf_dir):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    long = F.concat_ws(" ", name, segment, name, segment)
    return customers(spark, sf_dir).select(
        "c_custkey", strings.pad_centre(segment, 14, "-").alias("centred"), strings.pad_left(segment, 12, "*").alias("padded_left"), strings.pad_right(segment, 12, "*").alias("padded_right"),
        strings.index_of(name, F.lit("CUST")).cast("long").alias("place"), strings.matches(segment, "[a-m].*").alias("matched"), strings.strip(segment, "A", "I").alias("stripped"),
        strings.strip(name, "L", "C").alias("left_stripped"), strings.xml_escaped(F.concat(F.lit("<\"&"), name)).alias("escaped"), strings.headline(long).alias("headline"),
        strings.initials(long).alias("initials"), strings.char((F.col("c_custkey") % 300).cast("int")).isNull().alias("no_char"), strings.code(segment).cast("long").alias("code"),
        strings.fill(F.lit("ab"), (F.col("c_custkey") % 5 - 1).cast("int")).alias("filled"), strings.in_context(name, F.when(F.col("c_nationkey") % 2 == 0, segment)).alias("in_context"),
        F.array_join(strings.pascal_parts(F.concat(F.lit("GetTotal"), segment)), "+").alias("parts"), strings.compact_count(F.col("c_custkey") * 37).alias("compact"),
    )


def folded_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(strings.fold_accents(strings.known(F.col("text"))).cast("binary")).alias("folded_md5"))


def list_functions(spark, sf_dir):
    s = F.concat_ws(",", "c_mktsegment", F.col("c_nationkey").cast("string"), "c_name", F.lit(""))
    at = (F.col("c_custkey") % 6).cast("int")
    return customers(spark, sf_dir).select(
        "c_custkey", lists.entry(at, s).alias("entry"), lists.count(s).cast("long").alias("n"), lists.lookup(F.lit("7"), s).cast("long").alias("place_of_7"),
        lists.remove(s, at, F.lit(2)).alias("two_less"), lists.remove(s, at, F.lit(-1)).alias("cut_off"), lists.sort(s).alias("sorted"),
        lists.count(F.replace(s, F.lit(","), F.lit("|")), "|").cast("long").alias("n_bars"),
        F.array_join(lists.top_level(F.concat(F.lit('f(a,b),"x,y",'), F.col("c_mktsegment"))), "|").alias("arguments"),
    )


def tag_functions(spark, sf_dir):
    s = F.concat(F.lit("Seg="), F.col("c_mktsegment"), F.lit(",Nation="), F.col("c_nationkey").cast("string"), F.lit(",plain"))
    return customers(spark, sf_dir).select(
        "c_custkey", tags.extract(s, "seg").alias("seg"), tags.extract(s, "plain").alias("no_tag"), tags.put(s, "NATION", F.lit("X")).alias("replaced"), tags.put(s, "New", F.col("c_name")).alias("added"),
        tags.range_label(F.col("c_acctbal"), "0:low,2000:mid,6000:high").alias("label"),
    )


def number_functions(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return parts.select(
        "p_partkey", numbers.remainder(key, size - 25).alias("remainder"), numbers.quotient(-key, size - 25).alias("quotient"), numbers.truncated(-F.col("p_retailprice"), 1).alias("truncated"),
        numbers.rounded(F.col("p_retailprice")).alias("rounded"), numbers.power(size.cast("double"), F.lit(2.0)).alias("squared"), numbers.in_words(size).alias("size_in_words"),
    )


def date_functions(spark, sf_dir):
    orders, at = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderdate")
    written = dates.formatted(at, "%d/%m/%Y")
    return orders.select(
        "o_orderkey", dates.formatted(at, "%a %d/%m/%Y at %H:%M").alias("written"), dates.to_day(written).cast("string").alias("day"), dates.to_day(F.col("o_orderpriority")).cast("string").alias("no_day"),
        dates.seconds_of_day(at).cast("long").alias("seconds"), dates.to_seconds(dates.formatted(at, "%H:%M")).cast("long").alias("read_seconds"), dates.to_seconds(F.lit("25:00")).cast("long").alias("no_seconds"),
        dates.dated_identifier("A", at, F.col("o_orderkey") % 1000).alias("identifier"), dates.bucket(at, F.lit("1998-08-01").cast("date")).alias("bucket"),
        dates.last_active(at, F.lit("1998-08-01").cast("date")).alias("last_active"),
    )


def conversions(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first, labels = F.left("o_orderpriority", F.lit(1)), {"O": "open", "F": "filled"}
    return orders.select(
        "o_orderkey", convert.to_integer(first).alias("number"), convert.to_integer(F.col("o_orderpriority")).alias("no_number"), convert.to_fractional(F.concat(first, F.lit(".5"))).alias("fractional"),
        convert.fractional_to_integer(-F.col("o_totalprice")).alias("whole"), convert.format_integer(F.col("o_orderkey"), "%08d").alias("padded"), convert.enum_label(F.col("o_orderstatus"), labels).alias("label"),
        convert.enum_code(convert.enum_label(F.col("o_orderstatus"), labels), labels).alias("code"), convert.to_text(F.col("o_custkey")).alias("text"),
    )


def cut_functions(spark, sf_dir):
    name, start, n = F.col("c_name"), (F.col("c_custkey") % 20 - 2).cast("int"), (F.col("c_custkey") % 7 - 1).cast("int")
    return customers(spark, sf_dir).select(
        "c_custkey", strings.trimmed(name, "Cus#0", "L").alias("left_trimmed"), strings.trimmed(name, "0123456789", "R").alias("right_trimmed"), strings.trimmed(name, "C0123456789").alias("trimmed"),
        strings.trimmed(name, "").alias("whole"), strings.part(name, start, n).alias("part"), strings.translated(name, "0123#", "abc").alias("translated"),
    )


def measure_functions(spark, sf_dir):
    rows, x = customers(spark, sf_dir), F.col("c_acctbal").cast("double")
    return rows.select(
        "c_custkey", F.round(numbers.logarithm(x), 6).alias("natural"), F.round(numbers.logarithm(x, 10), 6).alias("decimal"), F.round(numbers.logarithm(x, 2), 6).alias("binary"),
        F.round(numbers.root(x), 6).alias("root"), F.abs(x).alias("size"),
    )


def holiday_orders(spark, sf_dir):
    """Orders on and off the holidays of each year of the orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    years = orders.select(F.year("o_orderdate").alias("y")).distinct()
    days = F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (5, 1), (12, 25))])
    found = dates.with_holiday(orders, "o_orderdate", years.select(F.explode(days).alias("day")))
    return found.groupBy(F.year("o_orderdate").cast("long").alias("year"), "holiday").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


_FOLD = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"
_ONES = "[" + ", ".join(f"'{x}'" for x in numbers.ONES) + "]"
_TENS = "[" + ", ".join(f"'{x}'" for x in numbers.TENS) + "]"
_DAYS = "[" + ", ".join(f"'{x}'" for x in dates.DAYS) + "]"

ORACLE = {
    "string_functions": """WITH c AS (SELECT *, c_mktsegment AS s, c_name || ' ' || c_mktsegment || ' ' || c_name || ' ' || c_mktsegment AS l FROM customer)
SELECT c_custkey, CASE WHEN length(s) >= 14 THEN s ELSE rpad(repeat('-', CAST(ceil((14 - length(s)) / 2.0) AS INT)) || s, 14, '-') END AS centred,
  CASE WHEN length(s) >= 12 THEN s ELSE lpad(s, 12, '*') END AS padded_left, CASE WHEN length(s) >= 12 THEN s ELSE rpad(s, 12, '*') END AS padded_right,
  CAST(instr(lower(c_name), 'cust') AS BIGINT) AS place, regexp_full_match(s, '(?i)[a-m].*') AS matched, replace(s, 'I', '') AS stripped, ltrim(c_name, 'C') AS left_stripped,
  '&lt;&quot;&amp;' || c_name AS escaped, CASE WHEN length(l) <= 50 THEN l ELSE rtrim(l[1:50]) || '…' END AS headline, upper(c_name[1:1] || s[1:1]) AS initials,
  c_custkey % 300 > 255 AS no_char, CAST(ascii(s) AS BIGINT) AS code, repeat('ab', CAST(greatest(c_custkey % 5 - 1, 0) AS INT)) AS filled,
  CASE WHEN c_nationkey % 2 = 0 THEN '[Context: ' || s || ']' || chr(10) || chr(10) || c_name ELSE c_name END AS in_context,
  array_to_string(regexp_extract_all('GetTotal' || s, '[A-Z][a-z0-9]+'), '+') AS parts,
  CASE WHEN c_custkey * 37 < 1000 THEN CAST(c_custkey * 37 AS VARCHAR) ELSE (c_custkey * 37 + 50) // 1000 || ',' || (c_custkey * 37 + 50) // 100 % 10 || 'k' END AS compact FROM c""",
    "cut_functions": """WITH c AS (SELECT c_custkey, c_name AS s, CAST(c_custkey % 20 - 2 AS INT) AS a, CAST(c_custkey % 7 - 1 AS INT) AS n FROM customer)
SELECT c_custkey, regexp_replace(s, '^[Cus#0]+', '') AS left_trimmed, regexp_replace(s, '[0-9]+$', '') AS right_trimmed, regexp_replace(regexp_replace(s, '^[C0-9]+', ''), '[C0-9]+$', '') AS trimmed,
  s AS whole, CASE WHEN a >= 1 AND n > 0 THEN s[a : a + n - 1] ELSE '' END AS part, replace(replace(replace(replace(replace(s, '0', 'a'), '1', 'b'), '2', 'c'), '3', ''), '#', '') AS translated FROM c""",
    "measure_functions": """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS natural, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS decimal,
  CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 6) END AS "binary", CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root, CAST(abs(c_acctbal) AS DOUBLE) AS size FROM customer""",
    "holiday_orders": """SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '12-25') AS holiday, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY ALL""",
    "folded_texts": f"SELECT doc_id, md5({_FOLD.format("coalesce(text, '')")}) AS folded_md5 FROM documents",
    "list_functions": """WITH c AS (SELECT c_custkey, c_mktsegment AS seg, [c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, ''] AS e, CAST(c_custkey % 6 AS INT) AS i FROM customer)
SELECT c_custkey, CASE WHEN i BETWEEN 1 AND 4 THEN e[i] END AS entry, CAST(4 AS BIGINT) AS n, CAST(coalesce(list_position(e, '7'), 0) AS BIGINT) AS place_of_7,
  array_to_string(CASE WHEN i BETWEEN 1 AND 4 THEN list_concat(e[1 : i - 1], e[i + 2 :]) ELSE e END, ',') AS two_less,
  coalesce(array_to_string(CASE WHEN i BETWEEN 1 AND 4 THEN e[1 : i - 1] ELSE e END, ','), '') AS cut_off, array_to_string(list_sort(e), ',') AS sorted, CAST(4 AS BIGINT) AS n_bars,
  'f(a,b)|"x,y"|' || seg AS arguments FROM c""",
    "tag_functions": """SELECT c_custkey, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS no_tag, 'Seg=' || c_mktsegment || ',NATION=X,plain' AS replaced,
  'Seg=' || c_mktsegment || ',Nation=' || c_nationkey || ',plain,New=' || c_name AS added,
  CASE WHEN c_acctbal >= 6000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'mid' WHEN c_acctbal >= 0 THEN 'low' END AS label FROM customer""",
    "number_functions": f"""SELECT p_partkey, CASE WHEN p_size <> 25 THEN p_partkey % (p_size - 25) END AS remainder, CASE WHEN p_size <> 25 THEN CAST(trunc(-p_partkey / CAST(p_size - 25 AS DOUBLE)) AS BIGINT) END AS quotient,
  -floor(p_retailprice * 10) / 10 AS truncated, round(p_retailprice) AS rounded, CAST(p_size AS DOUBLE) * p_size AS squared,
  CASE WHEN p_size < 20 THEN {_ONES}[p_size + 1] ELSE {_TENS}[p_size // 10 - 1] || CASE WHEN p_size % 10 > 0 THEN '-' || {_ONES}[p_size % 10 + 1] ELSE '' END END AS size_in_words FROM part""",
    "date_functions": f"""SELECT o_orderkey, {_DAYS}[isodow(o_orderdate)] || strftime(o_orderdate, ' %d/%m/%Y at %H:%M') AS written, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS no_day,
  hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS seconds, hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 AS read_seconds, CAST(NULL AS BIGINT) AS no_seconds,
  'A' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') AS identifier,
  CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-08-01' THEN 'today' WHEN CAST(o_orderdate AS DATE) >= DATE '1998-07-31' THEN 'yesterday' WHEN CAST(o_orderdate AS DATE) >= DATE '1998-07-25' THEN 'last 7 days' ELSE 'older' END AS bucket,
  CASE WHEN DATE '1998-08-01' - CAST(o_orderdate AS DATE) <= 0 THEN 'today' WHEN DATE '1998-08-01' - CAST(o_orderdate AS DATE) = 1 THEN 'yesterday' ELSE CAST(DATE '1998-08-01' - CAST(o_orderdate AS DATE) AS VARCHAR) || ' d ago' END AS last_active FROM orders""",
    "conversions": """SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS number, CAST(NULL AS BIGINT) AS no_number, TRY_CAST(o_orderpriority[1:1] || '.5' AS DOUBLE) AS fractional, CAST(trunc(-o_totalprice) AS BIGINT) AS whole,
  printf('%08d', o_orderkey) AS padded, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS label, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS code, CAST(o_custkey AS VARCHAR) AS text FROM orders""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
