"""Publishing, catalog tables and the stream."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.plans import scans
from tests.test_skew import plan, settings
from tillroll import fixtures, registry, schemas
from tillroll.operators.linkage import linkage_profile, profile_of
from tillroll.operators.flatten import FLATTEN
from tillroll.sinks import catalog
from tillroll.sinks import publish as publishing
from tillroll.sinks.publish import (
    ConcurrentPublish,
    ConstraintViolation,
    manifests,
    publish,
    published_keys,
    read_published,
    read_rejected,
    tag_plain,
    unpublished,
)
from tillroll.sources.catalog import find_tables, point_lookup, preview
from tillroll.sources.jdbc import jdbc_options
from tillroll.sources.jsonl import parse_lines, read_jsonl
from tillroll.streaming.feed import publish_receipts, start_receipt_feed


def receipt(name, **more):
    return json.dumps({"_id": {"$oid": name}} | more)


def flat(spark, table, *lines):
    return FLATTEN[table](parse_lines(spark.createDataFrame([(line,) for line in lines], "value string")))


def ids(df, column="receipt_id"):
    return sorted(r[column] for r in df.collect())


def test_publish(spark, tmp_path, caplog):
    root = str(tmp_path / "lake")
    tables = {
        "receipts": flat(spark, "receipts", receipt("a"), receipt("b"), receipt("c", totalSpent="x")),
        "items": flat(spark, "items", receipt("a", rewardsReceiptItemList=[{"barcode": "1"}, {}])),
        "users": flat(spark, "users", "{}"),
    }
    counts = {r.table_name: (r.accepted_rows, r.rejected_rows) for r in publish(spark, root, "one", tables).collect()}
    assert counts == {"receipts": (2, 1), "items": (2, 0), "users": (0, 1)}
    assert "users: no rows to publish" in caplog.text
    assert ids(read_published(spark, root, "receipts")) == ["a", "b"]
    assert read_published(spark, root, "users").count() == 0
    assert read_rejected(spark, root, "receipts").first().reject_reason == "total_spent: not a number"

    # the same batch again replaces itself
    publish(spark, root, "one", tables)
    assert ids(read_published(spark, root, "receipts")) == ["a", "b"]
    # another batch is added
    publish(spark, root, "two", {"receipts": flat(spark, "receipts", receipt("d"))})
    assert ids(read_published(spark, root, "receipts")) == ["a", "b", "d"]

    # one bad table keeps the whole batch out
    for bad, reason in (
        ((receipt("e"), receipt("e")), "not unique"),
        ((receipt("e"), receipt("a")), "already published"),
    ):
        batch = {
            "receipts": flat(spark, "receipts", *bad),
            "users": flat(spark, "users", receipt("u")),
        }
        with pytest.raises(ConstraintViolation, match=reason):
            publish(spark, root, "three", batch)
        assert ids(read_published(spark, root, "receipts")) == ["a", "b", "d"]
        assert read_published(spark, root, "users").count() == 0
    assert sorted({r.batch for r in manifests(spark, root).collect()}) == ["one", "two"]

    new = flat(spark, "receipts", receipt("a"), receipt("z")).drop("reject_reason", "source")
    assert ids(unpublished(new, read_published(spark, root, "receipts"), "receipt_id")) == ["z"]


def test_publish_nothing_when_a_strict_source_fails(spark, tmp_path):
    source = tmp_path / "receipts.json"
    source.write_text(receipt("a") + "\n{oops\n")
    root = str(tmp_path / "lake")
    with pytest.raises(PySparkException):
        publish(spark, root, "one", {"receipts": FLATTEN["receipts"](read_jsonl(spark, str(source), "strict"))})
    assert manifests(spark, root).isEmpty()


def test_a_refused_batch_leaves_its_first_attempt(spark, tmp_path):
    root = str(tmp_path / "lake")
    publish(spark, root, "one", {"receipts": flat(spark, "receipts", receipt("a"))})
    with pytest.raises(ConstraintViolation, match="not unique"):
        publish(spark, root, "one", {"receipts": flat(spark, "receipts", receipt("x"), receipt("x"))})
    assert ids(read_published(spark, root, "receipts")) == ["a"]
    source = tmp_path / "receipts.json"
    source.write_text(receipt("b") + "\n{oops\n")
    with pytest.raises(PySparkException):
        publish(spark, root, "one", {"receipts": FLATTEN["receipts"](read_jsonl(spark, str(source), "strict"))})
    assert ids(read_published(spark, root, "receipts")) == ["a"]
    publish(spark, root, "one", {"receipts": flat(spark, "receipts", receipt("b"))})
    assert ids(read_published(spark, root, "receipts")) == ["b"]
    # an attempt without a table takes that table's rows of the batch away
    publish(spark, root, "one", {"users": flat(spark, "users", receipt("u"))})
    assert read_published(spark, root, "receipts").isEmpty()


def test_publish_checks_lengths(spark, tmp_path):
    users = spark.createDataFrame([("u", "Wisconsin")], "user_id string, state string")
    for f in schemas.USERS.fields[2:]:
        users = users.selectExpr("*", f"cast(null as {f.dataType.simpleString()}) as {f.name}")
    with pytest.raises(ConstraintViolation, match="users: text longer"):
        publish(spark, str(tmp_path), "one", {"users": tag_plain(users)})


def test_catalog(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    catalog.create_tables(spark, name)
    catalog.create_tables(spark, name)  # again: nothing happens
    found = find_tables(spark, ["receipts", "items", "users", "brands", "other"], name)
    assert ids(found, "tableName") == ["brands", "items", "receipts", "users"]
    users = flat(spark, "users", receipt("u", state="WI")).drop("reject_reason", "source")
    catalog.append(users.select(*reversed(users.columns)), "users", name)
    catalog.append(users, "users", name)
    table = spark.table(f"{name}.users")
    assert [r.state for r in table.collect()] == ["WI", "WI"]
    assert preview(table, 1).count() == 1 and point_lookup(table, "user_id", "u").count() == 2
    with pytest.raises(PySparkException, match="EXCEED_LIMIT_LENGTH"):
        catalog.append(users.selectExpr("* except(state)", "'WIS' as state"), "users", name)
    dedup = catalog.materialise(table.distinct(), f"{name}.users_dedup")
    assert dedup.count() == 1


def test_layout(spark, tmp_path, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    catalog.write_by_day(orders, str(tmp_path / "days"), "o_orderdate")
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == orders.count()
    one = days.filter("create_day = date '1998-10-03'")
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString()

    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    a = catalog.write_bucketed(orders.selectExpr("o_orderkey k", "o_custkey"), f"{name}.a", "k", 4)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = catalog.write_bucketed(items.selectExpr("l_orderkey k", "l_partkey"), f"{name}.b", "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_stream_continues_where_it_stopped(spark, tmp_path):
    source, root, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def arrive(*lines):
        spark.createDataFrame([(line,) for line in lines], "value string").write.mode("append").text(source)
        start_receipt_feed(spark, source, root, log).awaitTermination()
        return ids(read_published(spark, root, "receipts"))

    old, new = {"dateScanned": {"$date": 0}}, {"dateScanned": {"$date": 1_700_000_000_000}}
    assert arrive(receipt("a", **new), receipt("a", **new), receipt("b"), "oops") == ["a", "b"]
    # a repeat is dropped, a receipt that is years older than the newest one is not
    assert arrive(receipt("a", **new), receipt("c", **old)) == ["a", "b", "c"]
    # rejects are kept; a batch that is replayed replaces itself
    assert [r.source for r in read_rejected(spark, root, "receipts").collect()] == ["oops"]
    publish_receipts(spark.createDataFrame([(receipt("c", **old),)], "value string"), root, "feed-1")
    assert ids(read_published(spark, root, "receipts")) == ["a", "b", "c"]


def test_jdbc_options():
    options = jdbc_options("db.example.org", "shop", "me", "secret", batch_size=500)
    assert options["url"] == "jdbc:postgresql://db.example.org:5432/shop"
    assert (options["user"], options["password"], options["batchsize"]) == ("me", "secret", "500")


def plain_receipts(spark, *names):
    return {"receipts": flat(spark, "receipts", *(receipt(n) for n in names))}


def test_of_two_publishers_one_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish(spark, root, "zero", plain_receipts(spark, "a"))
    create = publishing.create_once

    def slow(session, path, text):
        """Another publisher of the same key comes first."""
        with monkeypatch.context() as m:
            m.setattr(publishing, "create_once", create)
            publish(spark, root, "other", plain_receipts(spark, "b"))
        return create(session, path, text)

    with monkeypatch.context() as m:
        m.setattr(publishing, "create_once", slow)
        with pytest.raises(ConcurrentPublish):
            publish(spark, root, "mine", plain_receipts(spark, "b"))
    assert ids(read_published(spark, root, "receipts")) == ["a", "b"]
    assert {r.batch for r in manifests(spark, root).collect()} == {"zero", "other"}
    with pytest.raises(ConstraintViolation, match="already published"):
        publish(spark, root, "mine", plain_receipts(spark, "b"))
    # Nothing is left of refused attempts.
    assert not list((tmp_path / "data" / "receipts").glob("batch=mine/attempt=*"))


def test_cost_of_a_batch_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(publishing, "COMPLETE", 3)
    monkeypatch.setattr(publishing, "BUCKETS", 8)
    asked = spark.createDataFrame([("b0-1",), ("new",)], "receipt_id string")
    seen = []
    for i in range(7):
        publish(spark, root, f"b{i}", plain_receipts(spark, *(f"b{i}-{k}" for k in range(20))))
        known = published_keys(spark, root, "receipts", asked)
        assert ids(known) == ["b0-1"]
        read = [s for s in scans(known) if "row_attempt" in s["plan"]]
        assert sum(s["partitions"] for s in read) <= 2
        seen.append((sum(s["files"] for s in read), len(publishing._manifest_files(spark, root)[1])))
    assert max(f for f, _ in seen) <= 2 and max(m for _, m in seen) <= 3
    assert len(ids(read_published(spark, root, "receipts"))) == 140
    # A batch that is replaced gives its keys free.
    publish(spark, root, "b0", plain_receipts(spark, "other"))
    assert ids(published_keys(spark, root, "receipts", asked)) == []
    assert len(ids(read_published(spark, root, "receipts"))) == 121


def test_materialise_reads_its_own_table(spark, tmp_path):
    name, path = f"m{uuid.uuid4().hex}", str(tmp_path)
    for i in range(4):
        old = spark.table(name) if i else spark.createDataFrame([], "n int")
        assert ids(catalog.materialise(old.union(spark.createDataFrame([(i,)], "n int")), name, path), "n") == list(range(i + 1))
    assert len(list(tmp_path.glob("version=*"))) == 2
    with pytest.raises(PySparkException):
        catalog.materialise(spark.sql(f"SELECT CAST(raise_error('lost') AS int) AS n FROM {name}"), name, path)
    with pytest.raises(ValueError, match="other columns"):
        catalog.materialise(spark.range(3), name, path)
    assert ids(spark.table(name), "n") == [0, 1, 2, 3]
    spark.sql(f"DROP TABLE {name}")


def test_lookup_skips_row_groups(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("sha1(cast(id as string)) AS k", "id")
    stored = catalog.write_for_lookup(rows, str(tmp_path), "k", 25_000)
    wanted = rows.filter("id = 777").agg(F.min("k")).scalar()
    found = stored.filter(F.col("k") == wanted)
    assert [r.id for r in found.collect()] == [777]
    assert min(s["rows"] for s in scans(found) if "id" in s["plan"]) < 30_000


def test_linked_tables_meet_without_a_shuffle(spark, tmp_path):
    n = spark.range(30_000)
    items = n.select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("r"), F.col("id") % 4000)).alias("k"), "id")
    receipts = spark.range(5000).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("k"))
    a, b = (f"t{uuid.uuid4().hex}" for _ in range(2))
    catalog.write_linked({a: receipts, b: items}, "k", 4, 1000, str(tmp_path))
    # A hot key and missing ones lie in plain files, which any number of tasks can read.
    assert {r.k for r in spark.table(f"{b}_hot").distinct().select("k").distinct().collect()} == {"hot", None}
    counts = catalog.linked_counts(spark, a, b, "k")
    assert profile_of(counts).first() == linkage_profile(receipts, items, "k").first()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        counts = catalog.linked_counts(spark, a, b, "k")
        counts.collect()
        text = plan(counts)
        # One exchange: that of the hot keys' counts.
        assert text.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" in text
    for t in (a, b, f"{a}_hot", f"{b}_hot"):
        spark.sql(f"DROP TABLE {t}")


def test_published_documents_are_dealt_out_before_parsing(spark, sf_dir):
    for name, rows in registry._flattened(fixtures.tables(spark, sf_dir)).items():
        assert "RebalancePartitions" in rows._jdf.queryExecution().optimizedPlan().toString(), name
