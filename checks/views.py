"""Input tables of the registered queries, derived from the given parquet tables.

Each Spark view has its SQL twin in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer beside its nation; the nation table has 25 rows whatever the scale."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey)


def dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).where("c_custkey % 3 <> 0")
    return c.select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("nation"),
    )


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    return customers(spark, sf_dir).select(
        "c_custkey",
        F.concat(F.lit('  "'), F.lower(seg), F.lit('" ')).alias("mkt"),
        F.concat(F.lit("["), seg, F.lit(", "), nat, F.lit("]")).alias("mkt_wrapped"),
        F.concat(seg, F.lit(" | "), nat).alias("mkt_delim"),
        F.concat(F.lit("cust: "), F.col("c_name")).alias("label"),
        F.when(F.col("c_custkey") % 7 != 0, nat).alias("nat"),
        F.concat(
            F.lit("This account belongs to the "),
            seg,
            F.lit(" market and is served from the regional office that looks after long term contracts"),
        ).alias("note"),
    )


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report side with two columns after the same source column, and one that is filled in six rows."""
    d = dash(spark, sf_dir)
    return d.withColumns({"again": F.col("segment"), "rare": F.when(F.col("c_custkey") <= 8, F.col("nation"))})


def skewed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of which one id owns six in ten, and others have none or a blank; cells with nulls and blanks."""
    digit = F.col("l_orderkey") % 10
    owner = F.when(digit < 6, "hot").when(digit == 6, F.lit(None)).when(digit == 7, " ").otherwise(F.col("l_suppkey").cast("string"))
    rest = F.col("l_partkey") % 7
    flag = F.when(rest == 0, F.lit(None)).when(rest == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select(
        owner.alias("owner"), *LINE_ORDER, F.col("l_quantity").cast("int").alias("quantity"), flag.alias("flag")
    )


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names beside themselves with the third character missing."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", mistyped("p_name").alias("p_name_typo"))


def order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: about ten rows per id, merged in order-key order."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items beside their part: hundreds of rows per supplier, merged in line order."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINE_ORDER, "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # Parts grow with the lines: as a file they may look small enough to broadcast, in memory they are not.
    return line.hint("merge").join(part.hint("merge"), line.l_partkey == part.p_partkey)


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_suppkey", *LINE_ORDER, "p_name", "p_brand", "p_type")


def mistyped(name: str) -> Column:
    return F.concat(F.substring(name, 1, 2), F.col(name).substr(F.lit(4), F.length(name)))


def returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report side: names of returned parts with the third character missing."""
    returned = lines(spark, sf_dir).where("l_returnflag = 'R'")
    return returned.select("l_suppkey", *LINE_ORDER, mistyped("p_name").alias("item"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size: some 40 rows per id, merged in key order."""
    return table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_name", "p_brand", "p_type")


def stocked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report side of the parts: two of three, their names with the third character missing."""
    kept = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    return kept.select("p_size", "p_partkey", mistyped("p_name").alias("item"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def doc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report side of the documents: their first four words, language and source."""
    words = F.slice(F.split("text", " "), 1, 4)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(words, " ").alias("opening"), F.col("lang").alias("language"), F.col("source").alias("origin")
    )
