"""A shipment inbox as a view over orders, lineitem, customer, supplier and nation.

One mail per order. Texts are put together from columns and defects follow the
order key (see FIXTURES.md), so expected results can be stated without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(nation: Column) -> Column:
    return F.concat(F.lit("N"), F.translate(F.lpad(nation.cast("string"), 4, "0"), "0123456789", "ABCDEFGHIJ"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the facts its documents state."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select(
        "n_nationkey", "n_name",
        F.concat(F.lit("PORT "), "n_name", F.lit(", "), "r_name").alias("place"),
        _code(F.col("n_nationkey")).alias("code"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"), F.count("*").alias("containers"),
        F.sum(F.col("l_quantity").cast("decimal(12,0)")).cast("bigint").alias("quantity"))
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_name").alias("shipper"), F.col("n_name").alias("shipper_nation"),
        F.col("place").alias("pol"), F.col("code").alias("pol_code"))
    customer = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_name").alias("consignee"), F.col("place").alias("pod"),
        F.col("code").alias("pod_code"))
    k = F.col("k")
    joined = (
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").alias("received_at"))
        .join(lines, F.col("k") == F.col("l_orderkey"), "left")
        .join(supplier, F.col("suppkey") == F.col("s_suppkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined.select(
        "k", "received_at", "suppkey", "shipper", "shipper_nation", "consignee", "containers",
        "pol", "pol_code", "pod", "pod_code",
        F.format_string("email_%08d", k).alias("email_id"),
        F.when(F.floor(k / 200) % 2 == 0, "participant").otherwise("synthetic_demo").alias("registry"),
        F.when(F.floor(k / 200) % 2 == 0, "EVAL").otherwise("DEMO").alias("run_kind"),
        (k % 10).cast("int").alias("m"),
        F.when(F.col("quantity").isNull(), 19).otherwise(F.floor(k / 10) % 20).cast("int").alias("d"),
        (1000 + 100 * F.col("quantity") + k % 7).alias("kg"),
    )


def emails(fact: DataFrame) -> DataFrame:
    k, m, d = F.col("k").cast("string"), F.col("m"), F.col("d")
    ask = (
        F.when(m == 0, "Congratulations, you have won a prize")
        .when(m == 1, F.concat(F.lit("Query on invoice "), k, F.lit(": please advise")))
        .when(m == 2, F.concat(F.lit("Please find attached shipping instructions for "), k,
                               F.lit(". Kindly prepare the draft.")))
        .when((m == 3) & (F.floor(F.col("k") / 10) % 2 == 0),
              F.concat(F.lit("Vessel schedule update for voyage "), k))
        .when(m == 3, "Good morning, noted with thanks.")
        .otherwise("Please compare the SI and draft BL and confirm the shipment details agree.")
    )
    tail = F.when(F.col("k") % 3 == 0,
                  "\n\nBest Regards,\nDesk 7\n\nOn Monday the desk wrote:\n> congratulations you have won, "
                  "compare the SI and draft BL\n> unsubscribe\n").otherwise("\n")
    subject = F.when((m >= 4) & (F.floor(F.col("k") / 10) % 5 == 0), F.concat(F.lit("REQUEST BL DRAFT "), k)) \
        .otherwise(F.concat(F.lit("Shipment "), k))
    base = F.concat(F.lit("attachments/"), F.col("email_id"))
    si, bl = F.concat(base, F.lit("_SI.txt")), F.concat(base, F.lit("_BL.txt"))
    second = F.concat(base, F.lit("_BL_rev2.txt"))
    attachments = (
        F.when((m < 4) | (d == 19), F.array().cast("array<string>"))
        .when(d == 13, F.array(si, bl, second)).otherwise(F.array(si, bl))
    )
    return fact.select(
        "run_kind", "registry", "email_id",
        F.concat(F.lit("desk"), (F.col("k") % 7).cast("string"), F.lit("@example.test")).alias("from_addr"),
        subject.alias("subject"), F.concat(F.lit("Dear all,\n\n"), ask, tail).alias("body"),
        attachments.alias("attachments"), "received_at",
    )


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _line(label: str, *value) -> Column:
    return F.concat(F.lit(f"{label}: "), *[v if isinstance(v, Column) else F.lit(v) for v in value])


def files(fact: DataFrame) -> DataFrame:
    """Attachment bytes of every comparison mail: registry, path, content."""
    d, kg = F.col("d"), F.col("kg")
    number = F.col("containers").cast("string")
    weight = kg.cast("string")
    street = F.concat(F.lit("  NO "), F.col("suppkey").cast("string"), F.lit(" DOCK ROAD; "), F.col("shipper_nation"))
    pol = F.concat("pol", F.lit(" ("), "pol_code", F.lit(")"))
    pod = F.concat("pod", F.lit(" ("), "pod_code", F.lit(")"))
    tonnes = F.floor(kg / 1000).cast("string")
    notify = F.when(d == 10, "SAME AS CONSIGNEE").otherwise(F.col("consignee"))
    si = _lines(
        "SHIPPING INSTRUCTION", "=" * 40, "",
        _line("Shipper/Exporter", F.col("shipper")), street,
        _line("CONSIGNEE", F.col("consignee")),
        _line("NOTIFY PARTY", notify),
        _line("Port of Loading", pol), _line("Discharge Port", pod),
        _line("No. of Containers or Packages", number, " x 40'HC"),
        F.when(d == 11, _line("Gross Weight (KG)", tonnes, "000 KG"))
        .when(d == 18, F.concat(F.lit("Gross Weight毛重(KGS): "), weight, F.lit(" KG")))
        .otherwise(_line("Gross Weight (KG)", weight, " KG")),
        "", _line("Booking Ref", F.lit("B"), F.col("k").cast("string")),
        F.when(F.col("registry") == "synthetic_demo",
               _line("Cargo Value", "USD ", F.format_number(1000 + F.col("k"), 0), ".50")),
    )
    gross = (
        F.when(d == 3, _line("Gross Wt (kgs)", (kg + 100).cast("string"), " KG"))
        .when(d == 5, _line("Gross Wt (kgs)", "N/A"))
        .when(d == 8, _line("Gross Wt", weight))
        .when(d == 9, _line("Gross Wt (kgs)", F.format_number(kg, 0), " KG"))
        .when(d == 11, _line("Gross Wt", tonnes, " MT"))
        .when(d == 14, _lines(_line("Gross Wt (kgs)", weight, " KG"),
                              _line("Gross Weight", (kg + 50).cast("string"), " KG")))
        .when(d == 15, _lines(_line("Gross Wt (kgs)", weight, " KG"),
                              _line("Total Gross Weight", weight, " KGS")))
        .otherwise(_line("Gross Wt (kgs)", weight, " KG"))
    )
    count = (
        F.when(d == 2, _line("Container Count", (F.col("containers") + 1).cast("string"), " x 40'HC"))
        .when(d == 16, _line("No. of Containers or Packages", number))
        .when(d == 18, _line("CONTAINER COUNT", number, " x 40’HC"))
        .otherwise(_line("Container Count", number, " x 40'HC"))
    )
    other_pod = F.concat(F.lit("OTHER "), pod)
    bl_body = _lines(
        "BILL OF LADING (DRAFT)", "=" * 40, "",
        F.when(d == 4, _line("SHIPPER", F.lit("OTHER "), F.col("shipper")))
        .otherwise(_line("SHIPPER", F.col("shipper"))), street,
        F.when(d == 1, _line("Consignee (Non-Negotiable)", "OTHER ", F.col("consignee")))
        .otherwise(_line("Consignee (Non-Negotiable)", F.col("consignee"))),
        _line("Notify Party", notify),
        F.when(d == 12, _line("Load Port", F.col("pol"))).otherwise(_line("Load Port", pol)),
        F.when(d == 4, _line("POD", other_pod)).otherwise(_line("POD", pod)),
        count, gross, "", _line("B/L No", "BL", F.col("k").cast("string")),
    )
    invoice = _lines(
        "COMMERCIAL INVOICE", "=" * 40, "This is not a shipping instruction", "",
        _line("Seller", F.col("shipper")), _line("Buyer", F.col("consignee")),
        _line("Invoice Amount", "USD ", F.format_number(1000 + F.col("k"), 0)))
    bl = F.when(d == 7, invoice).otherwise(bl_body)

    def utf8(text):
        return F.encode(text, "UTF-8")

    broken = F.concat(utf8(bl), F.lit(bytes([0x81])))
    base = F.concat(F.lit("attachments/"), F.col("email_id"))

    def entry(suffix, content):
        return F.struct(F.concat(base, F.lit(suffix)).alias("path"), content.alias("content"))

    listed = F.array_compact(F.array(
        entry("_SI.txt", utf8(si)),
        F.when(d != 6, entry("_BL.txt", F.when(d == 17, broken).otherwise(utf8(bl)))),
        F.when(d == 13, entry("_BL_rev2.txt", utf8(bl))),
    ))
    with_files = fact.filter((F.col("m") >= 4) & (d != 19))
    return with_files.select("registry", F.explode(listed).alias("f")).select("registry", "f.path", "f.content")


def inbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(emails, files) of the shipment inbox.

    The narrow facts are spread before texts are made of them: a small parquet
    file is one split, and all later work is per row.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fact = facts(spark, sf_dir).repartition(tasks, "k")
    return emails(fact), files(fact)
