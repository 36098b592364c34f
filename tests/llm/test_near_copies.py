"""Large groups of near copies in the n-gram Jaccard join."""

from pixelquilt.llm import jaccard_join


def test_copies_that_link_through_their_template_alone_are_few_pairs(spark, monkeypatch):
    """Copies with one word changed link with the template, but not with copies changed elsewhere."""
    template = [f"w{i}" for i in range(60)]
    texts = [" ".join(template)] + [" ".join([*template[:at], f"own{i}", *template[at + 1 :]]) for i in range(160) for at in [5 + i * 7 % 50]]
    texts += [f"a text of its own number {i} and nothing else" for i in range(20)]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, verified = [], jaccard_join._verified

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs).collect()}
    assert all(found[i + 1] == 1 for i in range(161))
    assert sum(compared) < 20 * len(texts), compared


def test_columns_of_one_row_alone_are_not_dealt(spark, monkeypatch):
    """Words of a copy's own make columns that nothing meets: cells are as many as the template's columns, and same links."""
    template = [f"w{i}" for i in range(80)]
    texts = [" ".join(template)] + [" ".join([*template[:at], f"own{i}", *template[at + 1 :]]) for i in range(120) for at in [5 + i * 7 % 70]]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    dealt, shared = [], jaccard_join._shared
    monkeypatch.setattr(jaccard_join, "_shared", lambda cells, label: dealt.append((label, cells.groupBy("gram").count().filter("count = 1").count())) or shared(cells, label))
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs).collect()}
    assert all(found[i + 1] == 1 for i in range(121))
    alone = dict(dealt)["late-cells"]
    assert alone < 120, alone  # five columns for each copy before


def test_columns_are_counted_in_arrays_where_the_sets_lie(spark):
    """No column of a set is a row of its own, and counts are those of a plain grouping; empty sets have none."""
    template = list(range(-300, 300))
    sets = [sorted({*[(x * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for x in template], i}) for i in range(200)] + [[], [5], [-(2**63), 2**63 - 1]]
    df = spark.createDataFrame([(len(s), s) for s in sets], "n long, grams array<long>").repartition(4).cache()
    blocks = jaccard_join._column_blocks(df, 8)
    assert blocks.count() <= 4 * 256 and blocks.selectExpr("sum(size(grams))").first()[0] < 4 * 601 + 210
    counts = jaccard_join._column_counts(df)
    plain = df.selectExpr("explode(grams) AS gram").groupBy("gram").count().filter("count > 1")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect())) and counts.count() == 601
    assert jaccard_join._column_counts(df.filter("n = 0")).isEmpty() and jaccard_join._column_counts(df.filter("n < 0")).isEmpty()
