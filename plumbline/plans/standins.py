"""The operators' inputs, derived from the given tables.

A sales star from lineitem, orders, customer, part and nation; campaign files,
route and media rows from events. Dirt is added by arithmetic on the event id,
so that Spark and the SQL checks see the same rows. ``World`` builds each frame
on first use; nothing is collected and nothing is cut down.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exact_round, fixed
from ..operators import etl, model, monitor, rules
from ..session import keep_methods_small, write_once


def pick(col: Column, options: dict, default=None) -> Column:
    out = F.lit(default)
    for value, label in reversed(list(options.items())):
        out = F.when(col == value, F.lit(label)).otherwise(out)
    return out


class World:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        keep_methods_small(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- star ---------------------------------------------------------------------
    @cached_property
    def fact(self) -> DataFrame:
        li, o, c = self.table("lineitem"), self.table("orders"), self.table("customer")
        price, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
        cost = (F.lit(0.30) + (F.col("l_partkey") % 50) * 0.01).cast("decimal(4,2)")
        # orders meet their customers first: the many lines then move once
        rows = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transactionid"), F.to_date("o_orderdate").alias("date"),
            F.col("l_partkey").alias("productkey"), F.col("c_nationkey").alias("geokey"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("channelkey"),
            F.ascii("c_mktsegment").alias("segmentkey"), F.col("l_quantity").cast("int").alias("quantity"),
            (price * (1 - disc)).cast("decimal(18,4)").alias("revenue_usd"),
            (price * cost).cast("decimal(18,4)").alias("cogs_usd"), (disc * 100).cast("double").alias("discount_pct"),
            exact_round(price.cast("double") / F.col("l_quantity"), 2).alias("unitprice_usd"),
            F.when(F.col("l_orderkey") % 997 == 0, "USD").otherwise(
                F.concat(F.lit("CUR"), F.col("c_nationkey") % 5)).alias("currency"),
            F.col("l_suppkey").alias("suppkey"), F.to_date("l_shipdate").alias("shipdate"))
        rows = rows.withColumn("margin_usd", (F.col("revenue_usd") - F.col("cogs_usd")).cast("decimal(18,4)"))
        pct = F.col("margin_usd").cast("double") / F.col("revenue_usd").cast("double") * 100
        return rows.withColumns({
            "margin_pct": exact_round(pct, 4), "year": F.year("date"), "month": F.month("date"),
            "quarter": F.concat(F.lit("Q"), F.quarter("date"))})

    ORDER = ["date", "productkey", "revenue_usd", "suppkey", "shipdate", "quantity"]

    @cached_property
    def clean(self) -> DataFrame:
        return model.clean_fact(self.fact, "transactionid", self.ORDER)

    @cached_property
    def product(self) -> DataFrame:
        p = self.table("part")
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 4
        return p.select(
            F.col("p_partkey").alias("productkey"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"),
            pick(number, {0: "LUXE", 1: "CPD", 2: "PPD"}, "Active Cosmetics").alias("division"),
            pick(F.col("p_type"), {"PROMO": "Skincare", "ECONOMY": "Makeup", "STANDARD": "Haircare", "MEDIUM": "Fragrance",
                                   "LARGE": "Digital"}, "Other").alias("category"),
            F.when(F.col("p_size") % 10 != 0, F.element_at(F.split("p_name", " "), 2)).alias("subcategory"),
            F.col("p_type").alias("type"))

    @cached_property
    def geography(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("geokey"), F.col("n_name").alias("country"),
            F.format_string("N%02d", "n_nationkey").alias("countrycode"), F.col("r_name").alias("region"),
            F.concat(F.lit("CUR"), F.col("n_nationkey") % 5).alias("currency"))

    @cached_property
    def channel(self) -> DataFrame:
        p = self.table("orders").select("o_orderpriority").distinct()
        key = F.left("o_orderpriority", F.lit(1)).cast("int")
        return p.select(
            key.alias("channelkey"), pick(key, {1: "E-commerce", 2: "D2C"}, None).alias("_c"), "o_orderpriority").select(
            "channelkey", F.coalesce("_c", F.substring("o_orderpriority", 3, 100)).alias("channel"),
            F.when(F.col("channelkey") <= 2, "Online").otherwise("Store").alias("channeltype")).withColumn(
            "is_digital", F.lower("channel").isin(*fixed.DIGITAL_CHANNELS))

    @cached_property
    def segment(self) -> DataFrame:
        return self.table("customer").select("c_mktsegment").distinct().select(
            F.ascii("c_mktsegment").alias("segmentkey"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def dates(self) -> DataFrame:
        d = self.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
        return d.select("date", F.date_format("date", "MMMM").alias("month_name"),
                        F.concat(F.lit("Q"), F.quarter("date"), F.lit(" "), F.year("date")).alias("quarter_year"),
                        F.date_format("date", "EEEE").alias("weekday_name"),
                        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
                        F.month("date").isin(11, 12).alias("is_holiday_season"))

    @cached_property
    def security(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.concat(F.lit("user"), "s_suppkey", F.lit("@corp.com")).alias("useremail"),
                        F.when(F.col("s_suppkey") % 10 == 0, " all ").otherwise(
                            F.format_string("n%02d", "s_nationkey")).alias("countrycode"))

    @cached_property
    def enriched(self) -> DataFrame:
        return model.enriched(self.clean, {
            "productkey": (self.product, ["brand", "division", "category", "subcategory"]),
            "geokey": (self.geography, ["country", "countrycode", "region"]),
            "channelkey": (self.channel, ["channel", "channeltype", "is_digital"]),
            "segmentkey": (self.segment, ["segment"]),
            "date": (self.dates, ["month_name", "quarter_year", "weekday_name", "is_weekend", "is_holiday_season"])})

    @cached_property
    def brands(self) -> DataFrame:
        return model.brand_dim(self.product)

    @cached_property
    def categories(self) -> DataFrame:
        return model.category_dim(self.product)

    @cached_property
    def slim(self) -> DataFrame:
        return model.build_slim(self.product, self.brands, self.categories)

    # --- campaign files ---------------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        e = self.table("events")
        i, uid, ts, kind = F.col("event_id"), F.col("user_id"), F.col("ts"), F.col("event_type")
        run = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")) + 1
        sent = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.floor((run - 1) / 3).cast("int") * 3)
        def hit(m: int) -> Column:
            return i % m == 0
        def day(c: Column) -> Column:
            return F.date_format(c, "dd/MM/yyyy HH:mm")
        address = F.concat(F.lit("user"), uid, F.lit("@mail"), uid % 7, F.lit(".com"))
        reads, acts = kind.isin("view", "click"), kind.isin("click", "purchase")
        cols = {
            "email": F.when(hit(97), "bad@mail").when(hit(89), "").when(hit(11), F.upper(address)).otherwise(address),
            "jyv": F.lit(""),
            "badmail": F.when((kind == "error") & hit(2), "HARD").otherwise("-"),
            "baja": F.when(hit(17), "SI").otherwise("NO"),
            "fecha_envio": F.when(hit(101), F.date_format(sent, "yyyy-MM-dd HH:mm")).otherwise(day(sent)),
            "fecha_open": F.when(hit(103), "31/31/2013 10:00")
                           .when(reads & hit(19), day(sent - F.make_dt_interval(mins=F.lit(90))))
                           .when(reads, day(ts)).when((kind == "purchase") & hit(5), "").otherwise("-"),
            "opens": F.when(hit(107), "abc").when(hit(109), "-").when(kind == "view", (1 + i % 4).cast("string"))
                      .when(kind == "click", (1 + i % 2).cast("string")).otherwise("0"),
            "opens_virales": (i * 7 % 3).cast("string"),
            "fecha_click": F.when(hit(113), "soon").when(acts, day(ts + F.make_dt_interval(mins=F.lit(5)))).otherwise("-"),
            "clicks": F.when(kind == "click", (1 + i % 2).cast("string")).when(kind == "purchase", "1").otherwise("0"),
            "clicks_virales": (i % 2).cast("string"),
            "links": F.when(acts & ~hit(23), (i % 50).cast("string")).when((kind == "view") & hit(29), "7").otherwise(""),
            "ips": F.when((kind == "error") & hit(3), "-").otherwise(F.concat(
                F.lit("10.0."), uid % 250, F.lit(".1"),
                F.when(hit(4), F.concat(F.lit(", 10.1."), i % 250, F.lit(".2"))).otherwise(""))),
            "navegadores": pick(i % 4, {0: "Chrome", 1: "Firefox", 2: "Safari"}, "-"),
            "plataformas": F.concat(pick(i % 5, {0: "Windows", 1: "Android", 2: "iOS", 3: ""}, "Mac"),
                                    F.when(hit(127), "\r").otherwise("")),
        }
        run_id = run.cast("long")
        return e.select(run_id.alias("id_ejecucion"), (run_id * 10 + i % 3).alias("file_id"),
                        (F.floor(i / 3) + 2).cast("long").alias("line_no"), *[c.alias(n) for n, c in cols.items()])

    LINEAGE = ("id_ejecucion", "file_id", "line_no")

    @cached_property
    def staged(self) -> DataFrame:
        return etl.stage(self.raw)

    @cached_property
    def work(self) -> DataFrame:
        return etl.type_records(self.staged, self.LINEAGE)

    @cached_property
    def ranked(self) -> DataFrame:
        """The work table of the load: written once, read by all later steps."""
        return write_once(etl.rank_sends(self.work, ["id_ejecucion"]), "work")

    @cached_property
    def incidents(self) -> DataFrame:
        """The audit table of the load."""
        return write_once(rules.incidents(self.ranked, self.LINEAGE), "incidents")

    @cached_property
    def loaded(self) -> DataFrame:
        """Ranked rows of the runs that did not fail."""
        return self.ranked.filter(self.DONE)

    # A query that reads a layer once, or a few of its columns, takes it from the records instead of the work table: what it does not need is
    # then neither made nor moved nor written.
    DONE = "id_ejecucion % 11 <> 0"

    @cached_property
    def loaded_records(self) -> DataFrame:
        """``loaded`` before it is ranked."""
        return self.work.filter(self.DONE)

    @cached_property
    def sends(self) -> DataFrame:
        """The keys of ``stats``."""
        return etl.sends(self.loaded_records)

    SEQ = ("id_ejecucion", "file_id", "line_no")
    AS_OF = "2024-01-20"

    @cached_property
    def stats(self) -> DataFrame:
        return etl.statistics(self.loaded, seq=self.SEQ).drop("_first", "_last")

    @cached_property
    def visits(self) -> DataFrame:
        return etl.visits(self.loaded, seq=self.SEQ).drop("_first", "_last")

    @cached_property
    def visitors(self) -> DataFrame:
        return etl.build_visitors(self.visits, self.AS_OF)

    @cached_property
    def files(self) -> DataFrame:
        return self.files_of(self.ranked)

    def files_of(self, rows: DataFrame) -> DataFrame:
        """The files of the work table, or of its rows before they are ranked."""
        name = F.concat(F.lit("report_"), F.col("file_id"), F.lit(".txt"))
        fid = F.col("file_id")
        status = (F.when(fid % 13 == 0, fixed.FILE_REJECTED).when(fid % 17 == 0, "CARGADO")
                  .when(fid % 19 == 0, "RESPALDADO").otherwise(fixed.FILE_DONE))
        return rows.groupBy("id_ejecucion", "file_id").agg(
            F.count(F.lit(1)).alias("registros_leidos"), F.sum(F.length("registro_completo")).alias("bytes")
        ).select("id_ejecucion", "file_id", name.alias("nombre_archivo"), F.sha2(name, 256).alias("hash_archivo"), "bytes",
                 "registros_leidos", status.alias("estatus"),
                 F.when(fid % 13 == 0, "layout").otherwise("").alias("motivo_rechazo"))

    @cached_property
    def runs(self) -> DataFrame:
        rid = F.col("id_ejecucion")
        f = self.files.groupBy("id_ejecucion").agg(
            F.count(F.lit(1)).alias("archivos_detectados"),
            F.count_if(F.col("estatus") == fixed.FILE_DONE).alias("_done"),
            F.count_if(F.col("estatus") == fixed.FILE_REJECTED).alias("archivos_rechazados"))
        m = monitor.run_metrics(self.ranked, self.incidents).drop("archivos_rechazados", "estatus")
        day = F.lit("2024-01-01").cast("date") + (rid - 1).cast("int")
        status = (F.when(rid % 11 == 0, fixed.RUN_FAILED).when(rid % 13 == 0, fixed.RUN_OPEN)
                  .when(F.col("archivos_rechazados") > 0, fixed.RUN_WARN).otherwise(fixed.RUN_OK))
        return f.join(m, "id_ejecucion").select(
            "id_ejecucion", day.alias("fecha_negocio"),
            (day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(2), mins=(rid % 7).cast("int"))).alias("fecha_inicio"),
            status.alias("estatus"), "archivos_detectados",
            F.when(rid % 9 == 0, F.lit(0)).otherwise(F.col("_done")).cast("long").alias("archivos_cargados"),
            "archivos_rechazados",
            F.when(rid % 10 == 0, F.lit(0)).otherwise(F.col("registros_leidos")).cast("long").alias("registros_leidos"),
            "registros_cargados", "registros_error", "registros_advertencia",
            (F.floor(F.col("registros_leidos") / 10) + rid % 5).cast("long").alias("duracion_segundos"),
            F.when(rid % 11 == 0, "transform failed").otherwise("").alias("mensaje"))

    @cached_property
    def catalogue(self) -> DataFrame:
        return monitor.catalogue(self.spark)

    @cached_property
    def rulings(self) -> DataFrame:
        """Proposed rulings: one for every send, with some
        that break a rule of the register."""
        i, uid = F.col("event_id"), F.col("user_id")
        e = self.table("events")
        run = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        sent = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.floor(run / 3).cast("int") * 3)
        return e.select(
            i.alias("id_dictamen"), pick(i % 5, {0: "baja_con_actividad", 1: "clic_sin_apertura", 2: "fecha_anterior_al_envio",
                                                 3: "badmail_con_actividad"}, "otro").alias("tipo_caso"),
            F.concat(F.lit("user"), F.when(i % 31 == 0, uid + 10_000_000).otherwise(uid), F.lit("@mail"), uid % 7,
                     F.lit(".com")).alias("email"), sent.alias("fecha_envio"),
            pick(i % 6, {0: "VALIDO", 1: "SOSPECHOSO", 2: "ERROR_DE_ORIGEN", 3: "REQUIERE_NEGOCIO", 4: "VALIDO"},
                 "QUIZAS").alias("clasificacion"),
            F.when(i % 9 == 0, "too short").otherwise("the evidence supports this class").alias("justificacion"),
            F.when(i % 37 == 0, F.lit(1.5)).otherwise((i % 100) / 100).alias("confianza"))

    # --- route and media --------------------------------------------------------------------
    @cached_property
    def route_raw(self) -> DataFrame:
        i, kind = F.col("event_id"), F.col("event_type")
        bought = kind == "purchase"
        return self.table("events").select(
            F.year("ts").alias("anio"), F.month("ts").alias("mes"),
            F.concat(F.lit(" Origin_"), F.col("user_id") % 3, F.lit(" ")).alias("origen"),
            F.concat(F.lit("dest_"), i % 4).alias("destino"), F.hour("ts").alias("hora_compra"),
            F.when(i % 9 != 0, F.hour("ts") + 1).alias("hora_entrega"),
            F.when(i % 18 == 0, "CANCELLED").when(i % 27 != 0, "DELIVERED").alias("ejecucion_entrega"),
            bought.cast("int").alias("total_envios"),
            F.when(kind == "error", 0).otherwise(1 + i % 3).cast("int").alias("visitas"),
            (bought & (F.col("value") < 50)).cast("int").alias("entrega_a_tiempo"),
            (bought & (F.col("value") >= 80)).cast("int").alias("entrega_demorada"), i.alias("event_id"))

    @cached_property
    def route(self) -> DataFrame:
        from ..functions import standardize_text
        from ..operators.kpi import filter_route
        return filter_route(standardize_text(self.route_raw, {"origen": "upper", "destino": "upper"}),
                            2024, "ORIGIN_1", "DEST_2")

    @cached_property
    def media_raw(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            F.to_date("ts").alias("date"), F.concat(F.lit("C"), F.col("user_id") % 5).alias("campaign"),
            F.col("event_type").alias("channel"),
            F.when(i % 31 != 0, F.col("value").cast("decimal(12,2)")).alias("spend"),
            F.when(i % 41 == 0, 0).otherwise(i % 1000 * 10 + 10).cast("long").alias("impressions"),
            F.when(F.col("event_type") == "click", i % 7).alias("clicks"),
            F.when(i % 3 != 0, i % 5).alias("engagements"), (i % 4).alias("link_clicks"),
            F.when(i % 6 != 0, i % 20).alias("video_views"), i.alias("event_id"))

    # --- staffing: volumes and hourly curves from events; the split is a site parameter -------
    @cached_property
    def lanes(self) -> DataFrame:
        lane = F.when(F.col("event_type").isin("purchase", "signup"), "NC").otherwise("V2")
        return self.table("events").select(F.to_date("ts").alias("day"), lane.alias("lane"), F.hour("ts").alias("hour"))

    @cached_property
    def volume(self) -> DataFrame:
        return self.lanes.groupBy("day", "lane").agg((F.count(F.lit(1)) * 100).alias("volume"))

    @cached_property
    def split(self) -> DataFrame:
        return self.spark.createDataFrame(
            [("V2", "unload V2", 1.0, 120.0), ("V2", "sorter", 0.85, 90.0), ("V2", "sorter NC", 0.15, 40.0),
             ("NC", "unload NC", 1.0, 35.0), ("NC", "shipping", 1.0, 80.0)],
            "lane string, position string, position_share double, rate double")

    @cached_property
    def curve(self) -> DataFrame:
        hours = self.lanes.groupBy("lane", "hour").agg(F.count(F.lit(1)).alias("n"))
        total = hours.groupBy("lane").agg(F.sum("n").alias("t"))
        shares = hours.join(total, "lane").select("lane", "hour", exact_round(F.col("n") / F.col("t"), 6).alias("hour_share"))
        return self.split.select("lane", "position").join(shares, "lane").select("position", "hour", "hour_share")
