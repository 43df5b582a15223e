from martlens.llm.common import most_frequent


def test_most_frequent_takes_whole_count_steps_within_the_bound(spark):
    rows = [(f"w{i}", 1) for i in range(50)] + [(f"x{i}", 10) for i in range(5)] + [("y", 1000), ("z", 0), ("n", None)]
    counts = spark.createDataFrame(rows, "w string, n long")
    got = lambda bound: {r.w for r in most_frequent(counts, "n", bound).collect()}
    assert got(1) == got(5) == {"y"}
    assert got(6) == {"y", *(f"x{i}" for i in range(5))}
    assert len(got(56)) == 56 and len(got(10 ** 6)) == 56 and got(0) == set()
    assert most_frequent(counts.limit(0), "n", 5).count() == 0
