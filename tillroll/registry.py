"""Every operator and report as a named query over the given tables, with the SQL that
DuckDB answers the same question with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import fixtures
from tillroll.functions.calendar import month_window
from tillroll.functions.numbers import nan_to_null
from tillroll.operators import checks, flatten, joins, keys, linkage
from tillroll.plans import daily, marts, quality, refresh, states
from tillroll.plans.tables import Tables
from tillroll.session import configure, scratch_path
from tillroll.sinks import catalog
from tillroll.sinks import publish as publishing
from tillroll.sources.catalog import preview
from tillroll.sources.jsonl import parse_lines, read_jsonl, require_documents
from tillroll.streaming.daily import read_daily_counts, start_daily_counts
from tillroll.streaming.feed import start_receipt_feed

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fixtures.tables(configure(spark), sf_dir))


# -- linkage ---------------------------------------------------------------------------

# name -> (left, right, key)
LINKS = {
    "receipts_items": ("receipts", "items", "receipt_id"),
    "items_receipts": ("items", "receipts", "receipt_id"),
    "receipts_users": ("receipts", "users_dedup", "user_id"),
    "users_receipts": ("users_dedup", "receipts", "user_id"),
    "items_brands": ("items", "brands_cleaned", "barcode"),
    "brands_items": ("brands_cleaned", "items", "barcode"),
}
SUMMARIES = ("receipts_items", "receipts_users", "items_brands")


def _link(profile, name: str) -> Callable[[Tables], DataFrame]:
    left, right, key = LINKS[name]
    return lambda t: profile(getattr(t, left), getattr(t, right), key)


def _linkage_summaries(t: Tables) -> DataFrame:
    parts = [
        _link(linkage.linkage_summary, name)(t).select(F.lit(name).alias("link"), "*")
        for name in SUMMARIES
    ]
    return reduce(DataFrame.unionByName, parts)


# -- documents -------------------------------------------------------------------------


def _without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as the wall-clock values the other engine stores."""
    zoned = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _with_zone(df: DataFrame) -> DataFrame:
    """Timestamps as the typed tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def _round_trip(table: str, to_documents) -> Callable[[Tables], DataFrame]:
    """A table written as JSON documents, parsed and flattened again."""

    def build(t: Tables) -> DataFrame:
        # Parsing takes far more time than moving a row, and a table may lie in one split.
        documents = parse_lines(to_documents(getattr(t, table).hint("rebalance")))
        return _without_zone(flatten.accepted(flatten.FLATTEN[table](documents)))

    return build


def _faulty_items(t: Tables) -> DataFrame:
    """Item documents whose price is no number for returned items and null for kept ones."""
    price = (
        F.when(F.col("needs_fetch_review"), F.lit('"n/a"'))
        .when(F.col("user_flagged_new_item"), F.lit("null"))
        .otherwise(F.concat(F.lit('"'), F.col("final_price").cast("string"), F.lit('"')))
    )
    text = F.concat(
        F.lit('{"_id":{"$oid":"'), "receipt_id", F.lit('"},"rewardsReceiptItemList":[{"finalPrice":'),
        price, F.lit("}]}"),
    )
    return flatten.flatten_items(parse_lines(t.items.select(text.alias("value"))))


def _rejected_rows(t: Tables) -> DataFrame:
    reasons = _faulty_items(t).groupBy(flatten.REASON)
    return reasons.agg(F.count(F.lit(1)).alias("reason_rows"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def _line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a source of documents; those of error events lack their end."""
    cut = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)"))
    lines = _events(spark, sf_dir).select(F.coalesce(cut, "props").alias("value"))
    users = flatten.rejected(flatten.flatten_users(parse_lines(lines)))
    return users.groupBy(flatten.REASON).agg(F.count(F.lit(1)).alias("reason_rows"))


def _event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")
    return (
        _events(spark, sf_dir)
        .select("event_type", k)
        .groupBy("event_type")
        .agg(F.count("k").alias("parsed_rows"), F.sum("k").alias("sum_k"))
    )


# -- loading ---------------------------------------------------------------------------


def _flattened(t: Tables) -> dict[str, DataFrame]:
    # Parsing takes far more time than moving a row, and a table may lie in few splits. Rows dealt
    # by a key need no sort before; what is too large of one key is split.
    documents = {
        "receipts": fixtures.receipt_documents(t.receipts.hint("rebalance", "receipt_id")),
        "items": fixtures.item_documents(t.items.hint("rebalance", "receipt_id")),
        "users": fixtures.user_documents(t.users.hint("rebalance", "user_id")),
        "brands": fixtures.brand_documents(t.brands.hint("rebalance", "brand_id")),
    }
    return {name: flatten.FLATTEN[name](parse_lines(lines)) for name, lines in documents.items()}


def _publish_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.tables(configure(spark), sf_dir)
    root = scratch_path(spark, "published")
    publishing.publish(spark, root, "first", _flattened(tables))
    stored = [
        publishing.read_published(spark, root, name).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("stored_rows")
        )
        for name in ("receipts", "items", "users", "brands")
    ]
    listed = publishing.manifests(spark, root).select("table_name", "accepted_rows", "rejected_rows")
    return reduce(DataFrame.unionByName, stored).join(listed, "table_name")


def _unpublished(t: Tables) -> DataFrame:
    """Receipts of an export that covers everything, where all before last month is stored."""
    window = month_window(t.receipts, "date_scanned", 1)
    stored = t.receipts.filter(F.col("date_scanned") < window.select("lo").scalar())
    return publishing.unpublished(t.receipts, stored, "receipt_id")


def _fed(spark: SparkSession, lines: DataFrame) -> str:
    """The root of a feed that got the lines twice at once, and again in a later run."""
    source, root, log = (scratch_path(spark, n) for n in ("feed-in", "feed-out", "feed-log"))
    for arriving in (lines.unionAll(lines), lines):
        arriving.write.mode("append").text(source)
        start_receipt_feed(spark, source, root, log).awaitTermination()
    return root


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts streamed from JSON files that hold every document three times."""
    tables = fixtures.tables(configure(spark), sf_dir)
    root = _fed(spark, fixtures.receipt_documents(tables.receipts))
    return (
        publishing.read_published(spark, root, "receipts")
        .groupBy("rewards_receipt_status")
        .agg(F.count(F.lit(1)).alias("receipts"), F.sum("purchased_item_count").alias("items"))
    )


def _streamed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feed rejects of receipts whose open ones lost their end."""
    tables = fixtures.tables(configure(spark), sf_dir)
    lines = fixtures.receipt_documents(tables.receipts)
    open_ = F.col("value").contains('"SUBMITTED"')
    cut = F.when(open_, F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    root = _fed(spark, lines.select(cut.alias("value")))
    rejects = publishing.read_rejected(spark, root, "receipts").groupBy(flatten.REASON)
    return rejects.agg(F.count(F.lit(1)).alias("reason_rows"))


def _republished(good: bool) -> Query:
    """Receipts after their batch was published again: refused with repeated ids, or replaced."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = fixtures.tables(configure(spark), sf_dir)
        root = scratch_path(spark, "republished")
        receipts = _with_zone(tables.receipts)
        publishing.publish(spark, root, "batch", {"receipts": publishing.tag_plain(receipts)})
        finished = receipts.filter("rewards_receipt_status = 'FINISHED'")
        again = finished if good else finished.unionByName(finished)
        try:
            publishing.publish(spark, root, "batch", {"receipts": publishing.tag_plain(again)})
        except publishing.ConstraintViolation:
            if good:
                raise
        return (
            publishing.read_published(spark, root, "receipts")
            .groupBy("rewards_receipt_status")
            .agg(F.count(F.lit(1)).alias("receipts"), F.count_distinct("receipt_id").alias("receipt_ids"))
        )

    return build


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt documents read from files, with a blank line behind each and open receipts cut."""
    tables = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "documents")
    text = F.col("value")
    cut = F.when(text.contains('"SUBMITTED"'), F.expr("substr(value, 1, length(value) - 1)")).otherwise(text)
    fixtures.receipt_documents(tables.receipts).select(F.concat(cut, F.lit("\n  ")).alias("value")).write.text(path)
    rows = flatten.flatten_receipts(read_jsonl(spark, path, "lenient"))
    return rows.groupBy(flatten.REASON).agg(F.count(F.lit(1)).alias("reason_rows"))


def _strict_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand documents read from files by a strict source that must not be empty."""
    tables = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "documents")
    fixtures.brand_documents(tables.brands).write.text(path)
    documents = require_documents(read_jsonl(spark, path, "strict"), "brands")
    return _without_zone(flatten.accepted(flatten.flatten_brands(documents)))


def _nan_amounts(t: Tables) -> DataFrame:
    """Prices where those under review are NaN, which counts as missing."""
    price = F.when(F.col("needs_fetch_review"), F.lit(float("nan"))).otherwise(F.col("final_price"))
    return t.items.select(nan_to_null(price).alias("price")).agg(
        F.count(F.lit(1)).alias("item_rows"), F.count("price").alias("priced_rows"), F.max("price").alias("top_price")
    )


def _publish_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of whose items none can be stored: listed without rows, the rejects kept."""
    tables = fixtures.tables(configure(spark), sf_dir)
    root = scratch_path(spark, "rejected")
    text = F.concat(F.lit('{"_id":{"$oid":"'), "receipt_id", F.lit('"},"rewardsReceiptItemList":[{"finalPrice":null}]}'))
    items = flatten.flatten_items(parse_lines(tables.items.select(text.alias("value"))))
    publishing.publish(spark, root, "batch", {"items": items})
    return publishing.manifests(spark, root).select("table_name", "accepted_rows", "rejected_rows").crossJoin(
        publishing.read_rejected(spark, root, "items").agg(F.count(F.lit(1)).alias("kept_rejects"))
    )


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts per day, from files that are partitioned by day."""
    tables = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "days")
    catalog.write_by_day(tables.receipts, path)
    days = spark.read.parquet(path).groupBy(F.col("create_day").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("day_rows"))


def _key_index_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts in two batches, and a third refused because the last month's ids are published."""
    receipts = _with_zone(fixtures.tables(configure(spark), sf_dir).receipts)
    root = scratch_path(spark, "indexed")
    open_ = F.col("rewards_receipt_status") == "SUBMITTED"
    recent = receipts.filter(F.col("date_scanned") >= month_window(receipts, "date_scanned", 0).select("hi").scalar())
    refused = 0
    for name, rows in (("closed", receipts.filter(~open_)), ("open", receipts.filter(open_)), ("again", recent)):
        try:
            publishing.publish(spark, root, name, {"receipts": publishing.tag_plain(rows)})
        except publishing.ConstraintViolation:
            refused += 1
    by_status = publishing.read_published(spark, root, "receipts").groupBy("rewards_receipt_status")
    return by_status.agg(F.count(F.lit(1)).alias("receipts"), F.lit(refused).alias("refused_batches"))


def _typed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four typed tables, appended to and read back; a batch with a text too long is refused."""
    tables = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "typed")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    counts = []
    for name in ("receipts", "items", "users", "brands"):
        catalog.create_tables(spark, database)
        rows = _with_zone(getattr(tables, name))
        catalog.append(rows, name, database)
        key = "receipt_id" if name in ("receipts", "items") else rows.columns[0]
        refused = 0
        try:
            catalog.append(rows.withColumn(key, F.concat(key, F.lit("x" * 24))), name, database)
        except PySparkException:
            refused = 1
        stored = spark.table(f"{database}.{name}")
        counts.append(stored.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("stored_rows"), F.count_distinct(key).alias("distinct_keys"), F.lit(refused).alias("refused")))
    return reduce(DataFrame.unionByName, counts)


def _materialised_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated users stored as a table, replaced by a query over itself, and kept when one fails."""
    users = fixtures.tables(configure(spark), sf_dir).users
    path = scratch_path(spark, "materialised")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    staff = F.col("sign_up_source") == "SUPPLIER"
    catalog.materialise(users.filter(~staff).distinct(), name, path)
    catalog.materialise(spark.table(name).unionByName(users.filter(staff)).distinct(), name, path)
    failing = spark.table(name).withColumn("role", F.raise_error(F.lit("a source is lost")).cast("string"))
    try:
        catalog.materialise(failing, name, path)
    except PySparkException:
        return spark.table(name)
    raise AssertionError("the failing refresh went through")


# -- refreshes -------------------------------------------------------------------------


def _two_batches(table: refresh.Cleaned, second: str, again: str = "false") -> tuple[Query, Query]:
    """A cleaned table after two batches, and what the second one changed."""

    def build(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
        rows = getattr(fixtures.tables(configure(spark), sf_dir), table.source)
        root = scratch_path(spark, f"refreshed-{table.source}")
        refresh.apply_batch(spark, root, table, "one", rows.filter(f"NOT ({second})"))
        return root, refresh.apply_batch(spark, root, table, "two", rows.filter(f"({second}) OR ({again})"))

    return (
        lambda spark, sf_dir: refresh.read_clean(spark, build(spark, sf_dir)[0], table),
        lambda spark, sf_dir: build(spark, sf_dir)[1],
    )


_BRANDS_REFRESHED, _BRAND_CHANGES = _two_batches(refresh.BRANDS_CLEANED, "brand_id LIKE 'D%'")
_USERS_REFRESHED, _ = _two_batches(refresh.USERS_DEDUP, "sign_up_source = 'SUPPLIER'", "sign_up_source = 'MACHINERY'")

# Open receipts of even months come late.
_LATE = "rewards_receipt_status = 'SUBMITTED' AND month(date_scanned) % 2 = 0"


def _day_store(spark: SparkSession, sf_dir: str) -> tuple[Tables, daily.DayStore]:
    """Receipts and items by month: all but the late ones, counted, then the late ones."""
    t = fixtures.tables(configure(spark), sf_dir)
    store = daily.DayStore(scratch_path(spark, "days"), "month")
    arriving = t.receipts.withColumn("late", F.coalesce(F.expr(_LATE), F.lit(False)))
    # Whole items travel to their receipts once for both batches, and are kept until both are in place.
    items = daily.placed(store, arriving, t.items, "late").filter("late IS NOT NULL").persist()
    try:
        daily.add_batch(spark, store, "first", t.receipts.filter(f"({_LATE}) IS NOT TRUE"), items.filter("NOT late").drop("late"))
        daily.refresh(spark, store, t.brands)
        daily.add_batch(spark, store, "late", t.receipts.filter(_LATE), items.filter("late").drop("late"))
    finally:
        items.unpersist()
    return t, store


def _daily_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, store = _day_store(spark, sf_dir)
    daily.refresh(spark, store, t.brands)
    return daily.read_daily(spark, store)


def _top_from(answer, back: int) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, store = _day_store(spark, sf_dir)
        return answer(spark, store, t.brands, back)

    return build


def _states(spark: SparkSession, sf_dir: str) -> str:
    """States of receipts and items that came in two batches, the second one twice."""
    t = fixtures.tables(configure(spark), sf_dir)
    root = scratch_path(spark, "states")
    open_ = t.receipts.filter("rewards_receipt_status = 'SUBMITTED'")
    closed = t.receipts.filter("rewards_receipt_status <> 'SUBMITTED'")
    for batch, receipts in (("closed", closed), ("open", open_), ("open", open_)):
        items = joins.with_match(t.items, receipts, "receipt_id")
        states.add_states(spark, root, batch, {"receipts": (receipts, "receipt_id"), "items": (items, "receipt_id"), "barcodes": (items, "barcode")})
    return root


def _linkage_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _states(spark, sf_dir)
    return states.linkage_profile(states.merged(spark, root, "receipts"), states.merged(spark, root, "items"))


def _profiles_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _states(spark, sf_dir)
    columns = (("receipts", "receipts.receipt_id"), ("items", "items.receipt_id"), ("barcodes", "items.barcode"))
    return reduce(DataFrame.unionByName, [states.column_profile(states.merged(spark, root, n), c) for n, c in columns])


def _bucketed_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts and items in buckets of the receipt; receipts of more than six items count as hot."""
    t = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "linked")
    names = {n: f"{path.rsplit('/', 1)[1].replace('-', '_')}_{n}" for n in ("receipts", "items")}
    catalog.write_linked({names[n]: getattr(t, n) for n in names}, "receipt_id", 8, 7, path)
    return linkage.profile_of(catalog.linked_counts(spark, names["receipts"], names["items"], "receipt_id"))


def _streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts per day from a stream in which the open ones come behind all others."""
    receipts = fixtures.tables(configure(spark), sf_dir).receipts
    source, root, log = (scratch_path(spark, n) for n in ("daily-in", "daily-out", "daily-log"))
    for rows in (receipts.filter("rewards_receipt_status <> 'SUBMITTED'"), receipts.filter("rewards_receipt_status = 'SUBMITTED'")):
        fixtures.receipt_documents(rows).repartition(4).write.mode("append").text(source)
    start_daily_counts(spark, source, root, log, files=4).awaitTermination()
    return read_daily_counts(spark, root)


# -- lookups ---------------------------------------------------------------------------


def _stored_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest receipt's joined view, from files in the order of their keys."""
    t = fixtures.tables(configure(spark), sf_dir)
    path = scratch_path(spark, "lookup")
    keyed = (("receipts", "receipt_id"), ("items", "receipt_id"), ("users", "user_id"), ("brands", "barcode"))
    near = Tables(**{name: catalog.write_for_lookup(getattr(t, name), f"{path}/{name}", key) for name, key in keyed})
    newest = near.receipts.agg(F.max_by("receipt_id", F.struct("date_scanned", "receipt_id")))
    return quality.receipt_detail(near, newest.scalar())


def _latest_receipt(t: Tables) -> DataFrame:
    newest = t.receipts.agg(
        F.max_by("receipt_id", F.struct("date_scanned", "receipt_id")).alias("id")
    )
    return quality.star_view(t, t.receipts.filter(F.col("receipt_id") == newest.scalar()))


def _preview_sizes(t: Tables) -> DataFrame:
    sizes = [
        preview(df, 10).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("shown_rows"))
        for name, df in (("receipts", t.receipts), ("items", t.items), ("users", t.users), ("brands", t.brands))
    ]
    return reduce(DataFrame.unionByName, sizes)


def _by_barcode_presence(t: Tables) -> DataFrame:
    kept, review = joins.split_missing_keys(t.items, "barcode")
    parts = [
        rows.agg(
            F.lit(name).alias("destination"),
            F.count(F.lit(1)).alias("rows_sent"),
            F.sum("quantity_purchased").alias("quantity"),
        )
        for name, rows in (("accepted", kept), ("review", review))
    ]
    return reduce(DataFrame.unionByName, parts)


def _flagged(t: Tables) -> DataFrame:
    return t.items.select(F.col("user_flagged_barcode").alias("barcode"))


def _never_flagged(t: Tables) -> DataFrame:
    flagged = _flagged(t).filter("barcode IS NOT NULL")
    return joins.not_in(t.brands, flagged, "barcode").select("brand_id", "barcode", "name")


def _not_in_with_null(t: Tables) -> DataFrame:
    return joins.not_in(t.brands, _flagged(t), "barcode").agg(F.count(F.lit(1)).alias("brand_rows"))


QUERIES: dict[str, Query] = {
    # key uniqueness
    "key_profile_receipts": _on_tables(lambda t: keys.key_profile(t.receipts, ["receipt_id"])),
    "key_profile_users": _on_tables(lambda t: keys.key_profile(t.users, ["user_id"])),
    "key_profile_items": _on_tables(
        lambda t: keys.key_profile(t.items, ["receipt_id", ("receipt_id", "partner_item_id")])
    ),
    "key_profile_brands": _on_tables(lambda t: keys.key_profile(t.brands, ["brand_id", "barcode"])),
    "key_profile_users_dedup": _on_tables(lambda t: keys.key_profile(t.users_dedup, ["user_id"])),
    "key_profile_brands_cleaned": _on_tables(
        lambda t: keys.key_profile(t.brands_cleaned, ["brand_id", "barcode"])
    ),
    "duplicate_user_keys": _on_tables(lambda t: keys.duplicate_keys(t.users, "user_id")),
    "duplicate_barcodes": _on_tables(lambda t: keys.duplicate_keys(t.brands, "barcode")),
    "duplicate_barcode_count": _on_tables(lambda t: keys.duplicate_key_count(t.brands, "barcode")),
    "duplicate_excess": _on_tables(lambda t: keys.duplicate_excess(t.users, "user_id")),
    "exact_duplicate_check": _on_tables(lambda t: keys.duplicates_are_exact(t.users, "user_id")),
    "users_dedup": _on_tables(lambda t: t.users_dedup),
    "ambiguous_brand_rows": _on_tables(lambda t: keys.rows_with_duplicate_keys(t.brands, "barcode")),
    "brands_cleaned": _on_tables(lambda t: t.brands_cleaned),
    "brands_never_flagged": _on_tables(_never_flagged),
    "not_in_with_null": _on_tables(_not_in_with_null),
    "daily_receipts": _on_tables(lambda t: keys.daily_profile(t.receipts, "create_date", "receipt_id")),
    # linkage and other checks
    **{f"linkage_{name}": _on_tables(_link(linkage.linkage_profile, name)) for name in LINKS},
    "linkage_summary": _on_tables(_linkage_summaries),
    "null_profile": _on_tables(
        lambda t: checks.null_profile(t.items, ["receipt_id", "barcode", "user_flagged_barcode"])
    ),
    "status_domain": _on_tables(
        lambda t: checks.domain_check(
            t.receipts, "rewards_receipt_status", ["ACCEPTED", "FINISHED", "REJECTED"]
        )
    ),
    "too_long_reasons": _on_tables(
        lambda t: checks.too_long(t.receipts, {"bonus_points_earned_reason": 15}).select(
            "receipt_id", "bonus_points_earned_reason", "too_long"
        )
    ),
    "key_violations": _on_tables(lambda t: checks.key_violations(t.items, "barcode")),
    "issue_report": _on_tables(quality.issue_report),
    "star_one_receipt": _on_tables(_latest_receipt),
    "star_view": _on_tables(
        lambda t: quality.star_view(t).select(
            "r_receipt_id", "r_user_id", "u_user_id", "u_state", "i_partner_item_id", "i_barcode",
            "i_final_price", "b_brand_id", "b_name",
        )
    ),
    "preview_sizes": _on_tables(_preview_sizes),
    "quarantine_null_barcode": _on_tables(_by_barcode_presence),
    # business questions
    "month_window": _on_tables(lambda t: month_window(t.receipts, "date_scanned", 2, 1)),
    "top_brands_recent": _on_tables(lambda t: marts.top_brands(t, 1)),
    "top_brands_previous": _on_tables(lambda t: marts.top_brands(t, 2)),
    "brand_rank_change": _on_tables(marts.brand_rank_change),
    "status_avg_spend": _on_tables(lambda t: marts.status_avg_spend(t.receipts)),
    "status_items": _on_tables(lambda t: marts.status_items(t.receipts)),
    "status_compare": _on_tables(lambda t: marts.status_compare(t.receipts)),
    "new_user_brand_spend": _on_tables(marts.new_user_brand_spend),
    "new_user_brand_transactions": _on_tables(marts.new_user_brand_transactions),
    "new_user_top_brand": _on_tables(marts.new_user_top_brand),
    "new_user_top_spend": _on_tables(marts.new_user_top_spend),
    "daily_brand_receipts": _on_tables(marts.daily_brand_receipts),
    # documents and loading
    "json_receipts_roundtrip": _on_tables(_round_trip("receipts", fixtures.receipt_documents)),
    "json_items_explode": _on_tables(_round_trip("items", fixtures.item_documents)),
    "json_users_defaults": _on_tables(_round_trip("users", fixtures.user_documents)),
    "json_brands_ref": _on_tables(_round_trip("brands", fixtures.brand_documents)),
    "json_line_errors": _line_errors,
    "event_props_parse": _event_props,
    "rejected_rows": _on_tables(_rejected_rows),
    "publish_counts": _publish_counts,
    "unpublished_receipts": _on_tables(_unpublished),
    "streamed_receipts": _streamed,
    "streamed_rejects": _streamed_rejects,
    "file_line_errors": _file_lines,
    "file_brands_strict": _strict_file,
    "nan_amounts": _on_tables(_nan_amounts),
    "publish_all_rejected": _publish_rejected,
    "receipts_by_day": _by_day,
    "republish_refused": _republished(good=False),
    "republish_replaced": _republished(good=True),
    "key_index_refused": _key_index_refused,
    "typed_append": _typed_append,
    "materialised_users_dedup": _materialised_users,
    # refreshes and stored figures
    "brands_cleaned_incremental": _BRANDS_REFRESHED,
    "brand_changes": _BRAND_CHANGES,
    "users_dedup_incremental": _USERS_REFRESHED,
    "daily_brand_receipts_refreshed": _daily_refreshed,
    "top_brands_from_daily": _top_from(daily.top_brands, 1),
    "top_brands_previous_from_daily": _top_from(daily.top_brands, 2),
    "top_brands_partitioned": _top_from(daily.top_brands_of_days, 1),
    "linkage_from_states": _linkage_from_states,
    "profiles_from_states": _profiles_from_states,
    "bucketed_linkage": _bucketed_linkage,
    "stored_receipt_detail": _stored_detail,
    "streamed_daily_receipts": _streamed_daily,
}


# -- the same questions in SQL ---------------------------------------------------------


def _profile_sql(table: str, **distinct: str) -> str:
    counts = ", ".join(f"count(DISTINCT {key}) AS {name}" for name, key in distinct.items())
    return f"SELECT count(*) AS total_rows, {counts} FROM {table}"


def _linkage_sql(name: str) -> str:
    left, right, key = LINKS[name]
    return f"""
        SELECT count(*) AS joined_rows,
               count(l.{key}) AS left_non_null, count(DISTINCT l.{key}) AS left_distinct,
               count(r.{key}) AS right_non_null, count(DISTINCT r.{key}) AS right_distinct
        FROM {left} l LEFT JOIN {right} r ON l.{key} = r.{key}"""


def _summary_sql(name: str) -> str:
    left, right, key = LINKS[name]
    return f"""
        SELECT '{name}' AS link, l.n AS left_keys, r.n AS right_keys, b.n AS matched_keys,
               l.n - b.n AS left_orphans, r.n - b.n AS right_orphans,
               l.total AS left_rows, l.total - l.keyed AS left_null_rows,
               r.total - r.keyed AS right_null_rows,
               round(b.n * 100.0::double / l.n, 1) AS left_coverage_pct,
               round((l.n - b.n) * 100.0::double / l.n, 1) AS left_orphan_pct,
               round((r.n - b.n) * 100.0::double / r.n, 1) AS right_orphan_pct
        FROM (SELECT count(DISTINCT {key}) n, count(*) total, count({key}) keyed FROM {left}) l,
             (SELECT count(DISTINCT {key}) n, count(*) total, count({key}) keyed FROM {right}) r,
             (SELECT count(DISTINCT {key}) n FROM {left} WHERE {key} IN (SELECT {key} FROM {right})) b"""


def _month_sql(table: str, ts: str, back: int) -> str:
    """First instant of the month ``back`` months before the newest row's."""
    return f"(SELECT date_trunc('month', max({ts})) - INTERVAL {back} MONTH FROM {table})"


def _top_brands_sql(back: int) -> str:
    return f"""
        , scanned AS (
            SELECT receipt_id FROM receipts
            WHERE date_scanned >= {_month_sql("receipts", "date_scanned", back)}
              AND date_scanned < {_month_sql("receipts", "date_scanned", back - 1)})
        SELECT name AS brand_name, count(DISTINCT receipt_id) AS distinct_receipts
        FROM scanned LEFT JOIN items USING (receipt_id) LEFT JOIN brands_cleaned USING (barcode)
        GROUP BY name ORDER BY distinct_receipts DESC, brand_name NULLS LAST LIMIT 5"""


_MONEY = "CAST(sum(CAST({} AS decimal(18, 2))) AS double)"

_NEW_USERS_SQL = f"""
    , fresh AS (
        SELECT user_id FROM users_dedup
        WHERE created_date >= {_month_sql("users_dedup", "created_date", 6)}
          AND created_date < {_month_sql("users_dedup", "created_date", 0)}),
    by_brand AS (
        SELECT name AS brand_name, count(DISTINCT receipt_id) AS total_transactions,
               {_MONEY.format("final_price")} AS total_spent
        FROM receipts JOIN fresh USING (user_id) LEFT JOIN items USING (receipt_id)
             LEFT JOIN brands_cleaned USING (barcode)
        GROUP BY name)
"""

_STATUS_SQL = f"""
    , by_status AS (
        SELECT rewards_receipt_status AS status,
               {_MONEY.format("total_spent")} / count(total_spent) AS average_spent,
               CAST(sum(purchased_item_count) AS bigint) AS total_items_purchased
        FROM receipts GROUP BY status)
"""


def _compare_sql(measure: str) -> str:
    return f"""
        SELECT '{measure}' AS measure, CAST(a.{measure} AS double) AS first_value,
               CAST(b.{measure} AS double) AS second_value,
               CASE WHEN a.{measure} > b.{measure} THEN 'FINISHED'
                    WHEN a.{measure} < b.{measure} THEN 'REJECTED'
                    WHEN a.{measure} = b.{measure} THEN 'equal' END AS greater_status
        FROM (SELECT max({measure}) {measure} FROM by_status WHERE status = 'FINISHED') a,
             (SELECT max({measure}) {measure} FROM by_status WHERE status = 'REJECTED') b"""


def _issue_sql(issue: str, table: str, affected: str, out_of: str, resolution: str) -> str:
    return f"""
        SELECT '{issue}' AS issue, '{table}' AS table_name, a AS affected, n AS out_of,
               round(a * 100.0::double / n, 1) AS share_pct, '{resolution}' AS resolution
        FROM (SELECT CAST({affected} AS bigint) AS a, CAST({out_of} AS bigint) AS n)"""


def _unmatched(left: str, right: str, key: str) -> str:
    return f"""(SELECT count(DISTINCT {key}) FROM {left} l
                WHERE NOT EXISTS (SELECT 1 FROM {right} r WHERE r.{key} = l.{key}))"""


def _keys_in(table: str, key: str) -> str:
    return f"(SELECT count(DISTINCT {key}) FROM {table})"


_ISSUES_SQL = " UNION ALL ".join(
    [
        _issue_sql(
            "duplicate rows", "users",
            "(SELECT count(*) - count(DISTINCT user_id) FROM users)", "(SELECT count(*) FROM users)",
            "join to the deduplicated users",
        ),
        _issue_sql(
            "barcode of several brands", "brands",
            "(SELECT count(*) FROM brands) - (SELECT count(*) FROM brands_cleaned)",
            "(SELECT count(*) FROM brands)",
            "left out until the owner of the barcode is known",
        ),
        _issue_sql(
            "receipts without items", "receipts", _unmatched("receipts", "items", "receipt_id"),
            _keys_in("receipts", "receipt_id"), "ask whether the scan was incomplete",
        ),
        _issue_sql(
            "receipt users without user record", "receipts",
            _unmatched("receipts", "users_dedup", "user_id"), _keys_in("receipts", "user_id"),
            "ask for a full user export",
        ),
        _issue_sql(
            "item barcodes without brand", "items", _unmatched("items", "brands_cleaned", "barcode"),
            _keys_in("items", "barcode"), "complete the brand catalogue",
        ),
        _issue_sql(
            "brand barcodes without items", "brands",
            _unmatched("brands_cleaned", "items", "barcode"), _keys_in("brands_cleaned", "barcode"),
            "check how barcodes are recorded",
        ),
        _issue_sql(
            "items without barcode", "items", "(SELECT count(*) - count(barcode) FROM items)",
            "(SELECT count(*) FROM items)", "flag for review when loading",
        ),
        _issue_sql(
            "status ACCEPTED never used", "receipts",
            "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM receipts "
            "WHERE rewards_receipt_status = 'ACCEPTED')",
            "1", "ask for the list of statuses",
        ),
    ]
)


def _nulls_sql(column: str) -> str:
    return f"""
        SELECT '{column}' AS column_name, count(*) AS total_rows,
               count(*) - count({column}) AS null_rows,
               round((count(*) - count({column})) * 100.0::double / count(*), 1) AS null_pct
        FROM items"""


def _star_sql(receipts: str, columns: str) -> str:
    return f"""
        SELECT {columns}
        FROM {receipts} r LEFT JOIN users_dedup u ON r.user_id = u.user_id
             LEFT JOIN items i ON r.receipt_id = i.receipt_id
             LEFT JOIN brands_cleaned b ON i.barcode = b.barcode"""


def _prefixed_columns() -> str:
    from tillroll.schemas import TABLES

    return ", ".join(
        f"{p}.{f.name} AS {p}_{f.name}"
        for p, table in (("r", "receipts"), ("u", "users"), ("i", "items"), ("b", "brands"))
        for f in TABLES[table]
    )


def _size_sql(table: str) -> str:
    return f"SELECT '{table}' AS table_name, least(count(*), 10) AS shown_rows FROM {table}"


def _stored_sql(table: str, per_row: int = 1) -> str:
    n = f"count(*) * {per_row}"
    return f"""SELECT '{table}' AS table_name, {n} AS stored_rows, {n} AS accepted_rows,
                      0::bigint AS rejected_rows FROM {table}"""


_NEWEST_RECEIPT = "(SELECT * FROM receipts ORDER BY date_scanned DESC, receipt_id DESC LIMIT 1)"

_DAILY_BRANDS_SQL = """
    SELECT CAST(date_scanned AS date) AS day, name AS brand_name,
           count(DISTINCT receipt_id) AS distinct_receipts
    FROM receipts LEFT JOIN items USING (receipt_id) LEFT JOIN brands_cleaned USING (barcode)
    GROUP BY day, name"""


def _column_profile_sql(table: str, column: str) -> str:
    return f"""
        SELECT '{table}.{column}' AS column_name, sum(n)::BIGINT AS total_rows, count({column}) AS distinct_keys,
               count(*) FILTER ({column} IS NOT NULL AND n > 1) AS duplicate_keys,
               coalesce(sum(n) FILTER ({column} IS NULL), 0)::BIGINT AS null_rows,
               round(coalesce(sum(n) FILTER ({column} IS NULL), 0) * 100.0::double / sum(n), 1) AS null_pct
        FROM (SELECT {column}, count(*) AS n FROM {table} GROUP BY {column})"""


_ITEM_COLUMNS = """receipt_id, barcode, description, final_price, item_price, needs_fetch_review,
    partner_item_id, prevent_target_gap_points, quantity_purchased, user_flagged_barcode,
    user_flagged_new_item, user_flagged_price, user_flagged_quantity"""

# Queries over the fixture views.
_VIEW_SQL: dict[str, str] = {
    "key_profile_receipts": _profile_sql("receipts", distinct_receipt_id="receipt_id"),
    "key_profile_users": _profile_sql("users", distinct_user_id="user_id"),
    "key_profile_items": _profile_sql(
        "items",
        distinct_receipt_id="receipt_id",
        distinct_receipt_id_partner_item_id="receipt_id || '/' || partner_item_id",
    ),
    "key_profile_brands": _profile_sql(
        "brands", distinct_brand_id="brand_id", distinct_barcode="barcode"
    ),
    "key_profile_users_dedup": _profile_sql("users_dedup", distinct_user_id="user_id"),
    "key_profile_brands_cleaned": _profile_sql(
        "brands_cleaned", distinct_brand_id="brand_id", distinct_barcode="barcode"
    ),
    "duplicate_user_keys": """
        SELECT user_id, count(*) AS key_rows FROM users GROUP BY user_id HAVING count(*) > 1""",
    "duplicate_barcodes": """
        SELECT barcode, count(*) AS key_rows FROM brands GROUP BY barcode HAVING count(*) > 1""",
    "duplicate_barcode_count": """
        SELECT count(*) AS duplicate_keys
        FROM (SELECT barcode FROM brands GROUP BY barcode HAVING count(*) > 1)""",
    "duplicate_excess": """
        SELECT count(*) AS total_rows, count(DISTINCT user_id) AS keys,
               count(*) - count(DISTINCT user_id) AS excess_rows FROM users""",
    "exact_duplicate_check": """
        SELECT count(*) AS distinct_rows, count(DISTINCT user_id) AS distinct_keys,
               count(*) = count(DISTINCT user_id) AS duplicates_are_exact FROM users_dedup""",
    "users_dedup": "SELECT * FROM users_dedup",
    "ambiguous_brand_rows": """
        SELECT brands.* FROM brands
        JOIN (SELECT barcode FROM brands GROUP BY barcode HAVING count(*) > 1) USING (barcode)""",
    "brands_cleaned": "SELECT * FROM brands_cleaned",
    "brands_never_flagged": """
        SELECT brand_id, barcode, name FROM brands WHERE barcode NOT IN
            (SELECT user_flagged_barcode FROM items WHERE user_flagged_barcode IS NOT NULL)""",
    "not_in_with_null": """
        SELECT count(*) AS brand_rows FROM brands
        WHERE barcode NOT IN (SELECT user_flagged_barcode FROM items)""",
    "daily_receipts": """
        SELECT CAST(create_date AS date) AS day, count(*) AS day_rows,
               count(DISTINCT receipt_id) AS distinct_keys FROM receipts GROUP BY day""",
    **{f"linkage_{name}": _linkage_sql(name) for name in LINKS},
    "linkage_summary": " UNION ALL ".join(_summary_sql(name) for name in SUMMARIES),
    "null_profile": " UNION ALL ".join(
        _nulls_sql(c) for c in ("receipt_id", "barcode", "user_flagged_barcode")
    ),
    "status_domain": """
        , listed AS (SELECT unnest(['ACCEPTED', 'FINISHED', 'REJECTED']) AS value),
        found AS (SELECT rewards_receipt_status AS value, count(*) AS n FROM receipts GROUP BY value)
        SELECT coalesce(f.value, l.value) AS value, coalesce(n, 0) AS value_rows,
               l.value IS NOT NULL AS is_expected,
               CASE WHEN l.value IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'absent'
                    ELSE 'ok' END AS status
        FROM found f FULL JOIN listed l ON f.value = l.value""",
    "too_long_reasons": """
        SELECT receipt_id, bonus_points_earned_reason, 'bonus_points_earned_reason' AS too_long
        FROM receipts WHERE length(bonus_points_earned_reason) > 15""",
    "key_violations": """
        SELECT barcode, count(*) AS key_rows FROM items
        GROUP BY barcode HAVING count(*) > 1 OR barcode IS NULL""",
    "issue_report": _ISSUES_SQL,
    "star_one_receipt": _star_sql(_NEWEST_RECEIPT, _prefixed_columns()),
    "star_view": _star_sql(
        "receipts",
        """r.receipt_id AS r_receipt_id, r.user_id AS r_user_id, u.user_id AS u_user_id,
           u.state AS u_state, i.partner_item_id AS i_partner_item_id, i.barcode AS i_barcode,
           i.final_price AS i_final_price, b.brand_id AS b_brand_id, b.name AS b_name""",
    ),
    "preview_sizes": " UNION ALL ".join(_size_sql(t) for t in fixtures.VIEWS),
    "quarantine_null_barcode": """
        SELECT CASE WHEN barcode IS NULL THEN 'review' ELSE 'accepted' END AS destination,
               count(*) AS rows_sent, CAST(sum(quantity_purchased) AS bigint) AS quantity
        FROM items GROUP BY destination""",
    "month_window": f"""
        SELECT CAST({_month_sql("receipts", "date_scanned", 2)} AS timestamp) AS lo,
               CAST({_month_sql("receipts", "date_scanned", 1)} AS timestamp) AS hi""",
    "top_brands_recent": _top_brands_sql(1),
    "top_brands_previous": _top_brands_sql(2),
    "brand_rank_change": f"""
        , scanned AS (
            SELECT receipt_id,
                   date_scanned >= {_month_sql("receipts", "date_scanned", 1)} AS is_recent
            FROM receipts
            WHERE date_scanned >= {_month_sql("receipts", "date_scanned", 2)}
              AND date_scanned < {_month_sql("receipts", "date_scanned", 0)}),
        counts AS (
            SELECT name, is_recent, count(DISTINCT receipt_id) AS n
            FROM scanned LEFT JOIN items USING (receipt_id) LEFT JOIN brands_cleaned USING (barcode)
            GROUP BY name, is_recent),
        ranked AS (
            SELECT *, rank() OVER (PARTITION BY is_recent ORDER BY n DESC) AS pos FROM counts),
        recent AS (SELECT * FROM ranked WHERE is_recent),
        previous AS (SELECT * FROM ranked WHERE NOT is_recent)
        SELECT coalesce(recent.name, previous.name) AS brand_name,
               recent.n AS recent_receipts, recent.pos AS recent_rank,
               previous.n AS previous_receipts, previous.pos AS previous_rank,
               previous.pos - recent.pos AS rank_change
        FROM recent FULL JOIN previous ON recent.name IS NOT DISTINCT FROM previous.name
        WHERE recent.pos <= 5 OR previous.pos <= 5""",
    "status_avg_spend": f"""
        {_STATUS_SQL} SELECT status AS rewards_receipt_status, average_spent FROM by_status""",
    "status_items": f"""
        {_STATUS_SQL} SELECT status AS rewards_receipt_status, total_items_purchased FROM by_status""",
    "status_compare": f"""
        {_STATUS_SQL} {_compare_sql("average_spent")}
        UNION ALL {_compare_sql("total_items_purchased")}""",
    "new_user_brand_spend": f"{_NEW_USERS_SQL} SELECT brand_name, total_spent FROM by_brand",
    "new_user_brand_transactions": f"{_NEW_USERS_SQL} SELECT * FROM by_brand",
    "new_user_top_brand": f"""
        {_NEW_USERS_SQL}
        SELECT * FROM by_brand WHERE brand_name IS NOT NULL
        QUALIFY rank() OVER (ORDER BY total_transactions DESC, total_spent DESC) = 1""",
    "new_user_top_spend": f"""
        {_NEW_USERS_SQL}
        SELECT brand_name, total_spent FROM by_brand WHERE brand_name IS NOT NULL
        QUALIFY rank() OVER (ORDER BY total_spent DESC NULLS LAST) = 1""",
    "daily_brand_receipts": _DAILY_BRANDS_SQL,
    "json_receipts_roundtrip": "SELECT * FROM receipts",
    "json_items_explode": f"""
        SELECT {_ITEM_COLUMNS} FROM items
        UNION ALL
        SELECT receipt_id, barcode, NULL, 0.0, 0.0, false, partner_item_id || 'x', false, 0, NULL,
               false, 0.0, 0 FROM items""",
    "json_users_defaults": """
        SELECT user_id, state, created_date, last_login,
               CASE WHEN role IS NULL AND NOT active THEN 'CONSUMER' ELSE role END AS role,
               active, sign_up_source FROM users""",
    "json_brands_ref": "SELECT * FROM brands",
    "rejected_rows": """
        SELECT CASE WHEN needs_fetch_review THEN 'final_price: not a number'
                    WHEN user_flagged_new_item THEN 'final_price: null' END AS reject_reason,
               count(*) AS reason_rows
        FROM items GROUP BY reject_reason""",
    "publish_counts": " UNION ALL ".join(
        [_stored_sql("receipts"), _stored_sql("items", 2), _stored_sql("users"), _stored_sql("brands")]
    ),
    "unpublished_receipts": f"""
        SELECT * FROM receipts WHERE date_scanned >= {_month_sql("receipts", "date_scanned", 1)}""",
    "streamed_receipts": """
        SELECT rewards_receipt_status, count(*) AS receipts,
               CAST(sum(purchased_item_count) AS bigint) AS items
        FROM receipts GROUP BY rewards_receipt_status""",
    "streamed_rejects": """
        SELECT 'not valid JSON' AS reject_reason, 3 * count(*) AS reason_rows
        FROM receipts WHERE rewards_receipt_status = 'SUBMITTED'""",
    "file_line_errors": """
        SELECT CASE WHEN rewards_receipt_status = 'SUBMITTED' THEN 'not valid JSON' END AS reject_reason,
               count(*) AS reason_rows
        FROM receipts GROUP BY reject_reason""",
    "file_brands_strict": "SELECT * FROM brands",
    "nan_amounts": """
        SELECT count(*) AS item_rows, count(*) FILTER (needs_fetch_review IS NOT TRUE) AS priced_rows,
               max(final_price) FILTER (needs_fetch_review IS NOT TRUE) AS top_price
        FROM items""",
    "publish_all_rejected": """
        SELECT 'items' AS table_name, 0::bigint AS accepted_rows, count(*) AS rejected_rows, count(*) AS kept_rejects
        FROM items""",
    "receipts_by_day": """
        SELECT CAST(create_date AS date) AS day, count(*) AS day_rows FROM receipts GROUP BY day""",
    "republish_refused": """
        SELECT rewards_receipt_status, count(*) AS receipts, count(DISTINCT receipt_id) AS receipt_ids
        FROM receipts GROUP BY rewards_receipt_status""",
    "republish_replaced": """
        SELECT rewards_receipt_status, count(*) AS receipts, count(DISTINCT receipt_id) AS receipt_ids
        FROM receipts WHERE rewards_receipt_status = 'FINISHED' GROUP BY rewards_receipt_status""",
    "key_index_refused": """
        SELECT rewards_receipt_status, count(*) AS receipts, 1 AS refused_batches FROM receipts GROUP BY rewards_receipt_status""",
    "typed_append": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS stored_rows, count(DISTINCT {key}) AS distinct_keys, 1 AS refused FROM {t}"
        for t, key in (("receipts", "receipt_id"), ("items", "receipt_id"), ("users", "user_id"), ("brands", "brand_id"))
    ),
    "materialised_users_dedup": "SELECT * FROM users_dedup",
    "brands_cleaned_incremental": "SELECT * FROM brands_cleaned",
    "brand_changes": """
        SELECT *, 'removed' AS change FROM brands
        WHERE brand_id LIKE 'P%' AND barcode IN (SELECT barcode FROM brands WHERE brand_id LIKE 'D%')""",
    "users_dedup_incremental": "SELECT * FROM users_dedup",
    "daily_brand_receipts_refreshed": _DAILY_BRANDS_SQL,
    "top_brands_from_daily": _top_brands_sql(1),
    "top_brands_previous_from_daily": _top_brands_sql(2),
    "top_brands_partitioned": _top_brands_sql(1),
    "linkage_from_states": _linkage_sql("receipts_items"),
    "profiles_from_states": " UNION ALL ".join(
        _column_profile_sql(*c) for c in (("receipts", "receipt_id"), ("items", "receipt_id"), ("items", "barcode"))
    ),
    "bucketed_linkage": _linkage_sql("receipts_items"),
    "stored_receipt_detail": _star_sql(_NEWEST_RECEIPT, _prefixed_columns()),
    "streamed_daily_receipts": """
        , behind AS (SELECT max(create_date) - INTERVAL 30 DAY AS watermark FROM receipts WHERE rewards_receipt_status <> 'SUBMITTED')
        SELECT CAST(create_date AS date) AS day, count(*) AS day_rows,
               count(*) FILTER (rewards_receipt_status = 'SUBMITTED' AND create_date < watermark) AS late_rows
        FROM receipts, behind GROUP BY day""",
}

ORACLE_SQL: dict[str, str] = {
    name: f"{fixtures.duckdb_views()} {text}" for name, text in _VIEW_SQL.items()
} | {
    "json_line_errors": """
        SELECT CASE WHEN event_type = 'error' THEN 'not valid JSON' ELSE 'document has no id' END
                   AS reject_reason,
               count(*) AS reason_rows
        FROM events GROUP BY reject_reason""",
    "event_props_parse": """
        SELECT event_type, count(*) AS parsed_rows,
               CAST(sum(CAST(json_extract_string(props, '$.k') AS bigint)) AS bigint) AS sum_k
        FROM events GROUP BY event_type""",
}
