import pytest

from optika.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def dealt(available, wanted):
    """The cursor rule, unit by unit."""
    room, given = dict(available), dict.fromkeys(available, 0)
    order, cursor = [c for c in sorted(available) if available[c]], 0
    while wanted:
        c = order[cursor % len(order)]
        if not room[c]:
            order.remove(c)
            cursor %= len(order)
            continue
        room[c], given[c], cursor, wanted = room[c] - 1, given[c] + 1, cursor + 1, wanted - 1
    return {c: n for c, n in given.items() if available[c]}


def test_dealing_where_some_cells_are_scarce():
    import random

    import numpy as np

    from optika.operators.sampling import deal

    assert deal(np.array([1, 2, 11]), 4).tolist() == [1, 1, 2]
    r = random.Random(4)
    for _ in range(500):
        cells = {i: r.choice([0, 1, 2, 3, 7, 20]) for i in range(r.randint(1, 60))}
        wanted = r.randint(0, sum(cells.values()))
        want = dealt(cells, wanted)
        assert deal(np.array(list(cells.values())), wanted).tolist() == [want.get(i, 0) for i in cells]
    assert deal(np.arange(2000), 1_900_000).sum() == 1_900_000
    assert deal(np.array([], int), 0).tolist() == []
    with pytest.raises(ValueError, match="wanted"):
        deal(np.array([1]), 2)


def test_allocation_over_sources_and_strata(spark):
    from optika.operators.sampling import allocation

    def given(cells, wanted):
        rows = [(s, t) for (s, t), n in cells.items() for _ in range(n)]
        return {(r["source"], r["stratum"]): r["given"] for r in allocation(spark.createDataFrame(rows, "source string, stratum string"), wanted).collect()}

    got = given({("a", "x"): 20} | {("b", str(i)): 20 for i in range(5)}, 20)
    assert got["a", "x"] == 10 and sum(n for (s, _), n in got.items() if s == "b") == 10
    assert given({(None, "x"): 2, ("a", None): 2}, 3) == {("a", None): 2, (None, "x"): 1}
    assert given({("a", None): 2, ("a", "x"): 1}, 2) == {("a", "x"): 1, ("a", None): 1}


def test_allocation_of_many_cells(spark):
    """Two hundred thousand cells over a thousand sources; no cell reaches the driver."""
    from optika.operators.sampling import allocation

    rows = spark.range(500_000).selectExpr("cast(id % 1000 as string) source", "cast(id % 200000 as string) stratum")
    got = allocation(rows, 400_000)
    assert got.agg({"given": "sum"}).first()[0] == 400_000 and got.where("given > available").count() == 0 and got.count() == 200_000
    assert got.groupBy("source").sum("given").select("sum(given)").distinct().count() == 1


def test_records_carry_the_gold_text(spark, sf_dir):
    names = ["urgent", "high", "medium", "unspecified", "low"]
    rows = catalog.training_records(spark, sf_dir).limit(50).collect()
    gold = {str(r["sample_id"]): r["gold"] for r in catalog.orders_items(spark, sf_dir).collect()}
    assert all(r["gold_text"] == names[gold[r["sample_id"]]] for r in rows)


def test_distance_items_are_balanced(spark, sf_dir):
    from optika.operators import experiments, quality

    conditions = experiments.distance_conditions(spark, 9, 3).orderBy("distance_level").collect()
    assert len(conditions) == 7 and conditions[0]["relative_distance"] == 0 and conditions[-1]["relative_distance"] == 1
    for n, size, count in ((9, 3, 280), (8, 4, 35), (12, 3, 15_400)):
        assert experiments.equal_partitions(spark, n, size).count() == count
    with pytest.raises(ValueError, match="distances"):
        experiments.distance_conditions(spark, 4, 2)
    base = spark.range(9 * 6).selectExpr("cast(id as string) as sample_id", "cast(id % 9 as int) as gold")
    items = experiments.distance_items(base, 9, 3, 1)
    assert items.count() == 7 * 54
    assert quality.equal_counts(items, ["distance_level"], "gold").count() == 0
    assert items.where("get(ranks, gold) <> original_gold").count() == 0


def test_distance_records_have_all_fields(spark):
    from optika.operators import experiments, quality

    item = "'s' source, 'o' original_id, 'train' split, 'text' context, 'q' question, transform(sequence(1, 9), i -> format_string('Level %02d', i)) choices, cast(id % 9 as int) gold_position, format_string('Level %02d', id % 9 + 1) gold_label_text, 0.5D source_score, 'r' source_repo, 'v' source_revision, false context_truncated"
    rows = experiments.distance_records(spark.sql(f"SELECT cast(id as string) sample_id, {item} FROM range(54)"), 9, 3, 1)
    assert len(rows.columns) == 29 and rows.count() == 7 * 54
    assert rows.where("NOT get(choices, gold_position) <=> gold_label_text OR NOT get(choice_to_original_rank, gold_position) <=> original_gold_rank").count() == 0
    assert quality.versions_gate(rows, "pair_id", 7).count() == 0
    fixed = ["source", "original_id", "split", "context", "question", "gold_label_text", "gold_position", "option_count", "original_option_count", "original_gold_rank", "source_score"]
    assert quality.constant_within(rows, "pair_id", fixed).count() == 0
    assert quality.gold_balance(rows, "choices", "gold_label_text").where("leaks OR unequal").count() == 0
    assert quality.rising_means(rows, "distance_level", "mean_pairwise_rank_distance_normalized").count() == 0
    for c in ("gold_label_text", "gold_position", "gold_ordinal_rank_among_shown"):
        assert quality.equal_counts(rows, ["distance_level"], c).count() == 0
