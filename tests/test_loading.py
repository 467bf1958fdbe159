"""Primary keys checked at load, rejected CSV rows, and stacked result files."""

import pytest

from basketry.sources.constraints import KeyViolation, check_key, counting
from basketry.sources.files import read_csv_with_rejects, read_table, rejects_by_reason

HEADER = "order_id,order_item_id,product_id,seller_id,price,freight_value,note\n"
GOOD = [f"{i},1,{i % 3},7,{i}.50,1.00,n{i}" for i in range(7)]
BAD = ["8,1,2,7,free,1.00,x", "9,1,2", ",1,2,7,1.00,1.00,y"]


def test_bad_rows_are_set_aside(spark, tmp_path):
    rows = [GOOD[0], BAD[0], *GOOD[1:4], BAD[1], *GOOD[4:], BAD[2]]
    (tmp_path / "order_items.csv").write_text(HEADER + "\n".join(rows) + "\n")
    got = read_csv_with_rejects(spark, f"file://{tmp_path}", "order_items", reject_to=f"file://{tmp_path}/rejects")
    assert sorted(r.order_id for r in got.accepted.collect()) == list(range(7))
    assert sorted(str(r.price) for r in got.accepted.collect())[:2] == ["0.50", "1.50"]
    assert got.rejected.count() == 3
    assert {r.reason: r.rows for r in rejects_by_reason(got.rejected).collect()} == {"price: not a decimal(12,2)": 1, "malformed": 1, "order_id: no key": 1}
    assert "9,1,2" in [r.source for r in got.rejected.collect()]
    assert spark.read.parquet(f"file://{tmp_path}/rejects").count() == 3
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path), "order_items", "csv").collect()


def test_clean_files_load_whole(spark, tmp_path):
    (tmp_path / "order_items.csv").write_text(HEADER + "\n".join(GOOD) + "\n")
    got = read_csv_with_rejects(spark, str(tmp_path), "order_items")
    plain = read_table(spark, str(tmp_path), "order_items", "csv", check_keys=True)
    assert got.rejected.count() == 0 and sorted(got.accepted.collect()) == sorted(plain.collect())
    assert got.accepted.schema == plain.schema
    (tmp_path / "order_payments.csv").write_text("order_id,payment_type\n1,card\n")
    with pytest.raises(ValueError, match="header lacks"):
        read_csv_with_rejects(spark, str(tmp_path), "order_payments")


def test_timestamps_of_another_form_are_rejected(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text("order_id,review_score,review_creation_date\n1,5,2018-01-01 00:00:00\n2,5,2018-01-01\n3,,\n")
    got = read_csv_with_rejects(spark, str(tmp_path), "order_reviews")
    assert sorted(r.order_id for r in got.accepted.collect()) == [1, 3]
    assert [r.reasons for r in got.rejected.collect()] == [["review_creation_date: not a timestamp_ntz"]]


def test_broken_keys_raise_with_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 2), (2, 1), (2, 1), (None, 1), (3, None)], "order_id long, order_item_id int")
    with pytest.raises(KeyViolation) as broken:
        check_key(df, "order_items")
    assert (broken.value.null_rows, broken.value.repeated_keys, broken.value.surplus_rows) == (2, 2, 3)
    assert broken.value.examples == [(1, 1), (2, 1)]
    assert check_key(df.filter("order_id = 1 and order_item_id = 2"), "order_items").count() == 1
    assert check_key(df.limit(0), "order_items").count() == 0
    assert check_key(df, "geolocation") is df  # no key declared
    df.coalesce(1).write.parquet(f"{tmp_path}/order_items")
    with pytest.raises(KeyViolation):
        read_table(spark, str(tmp_path), "order_items", check_keys=True)
    assert read_table(spark, str(tmp_path), "order_items").count() == 8


def test_rows_are_counted_while_they_are_read(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "order_id long")
    watched, seen = counting(df, "orders")
    assert watched.filter("order_id > 1").count() == 1
    assert seen.get == {"rows": 3, "rows_without_key": 1}
