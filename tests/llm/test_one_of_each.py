"""One document of each class, whatever its id."""

from tablepact.llm import chosen_path


def test_ids_of_several_texts_and_rows_without_id(spark):
    words = [f"w{i}" for i in range(200)]
    a, near = " ".join(words), " ".join([*words[:-1], "other"])
    b, c = " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    near_c = c + " end"
    rows = [(1, a), (5, near), (5, b), (None, near), (None, a.replace(" ", "  ")), (None, c), (None, c.replace(" ", "\t")),
            (None, near_c), (None, "b " + b), (7, None), (8, " "), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    kept = {r["row"] for r in chosen_path.one_of_each(docs).collect()}
    assert kept - {5, 6, 7} == {0, 2, 9, 10, 11, 12} and len(kept & {5, 6, 7}) == 1


def test_documents_keep_columns_of_any_name(spark):
    """Names the operators use themselves come back as they were."""
    from tablepact.llm import quality_classifier, quality_rules, url_filter
    words = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [(1, words, "k", 7, "s"), (2, words, "l", 8, "t"), (2, words, "l", 8, "t"), (3, "", "m", 9, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _bare int, _Score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["_key"], r["_bare"]) for r in chosen_path.one_of_each(docs).collect()} == {(1, "k", 7), (3, "m", 9)}
    kept = quality_classifier.passed(docs, labels, 0.0)
    assert kept.columns == docs.columns and {r["_Score"] for r in kept.collect()} == {"s", "t", "u"}
    named = docs.withColumnRenamed("_bare", "_words")
    judged = quality_rules.judged(named, quality_rules.fit(named, labels))
    assert {r["_words"] for r in judged.collect()} == {7, 8, 9}
    pages = spark.createDataFrame([(1, "http://a.net/x", "r"), (2, "http://b.org/fr/y", "q")], "page_id long, url string, _rule string")
    assert {r["_rule"] for r in url_filter.judged(pages).collect()} == {"q", "r"}


def test_a_worker_keeps_nothing_of_other_operators(spark):
    """The caches of the tokenizer do not stay beside a join of near-duplicates."""
    from tablepact.llm import common, tokens
    path = tokens.default_tokenizer()
    before = tokens.worker_tokenizer(path)
    assert tokens.worker_tokenizer(path) is before
    ran = []

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            ran.extend(run(iter([])))
    chosen_path.next_level(Table())
    after = tokens.worker_tokenizer(path)
    assert not ran and after is not before and after.encode(["a b"]) == before.encode(["a b"])
    common.let_go()
    assert tokens.worker_tokenizer(path) is not after


def test_the_classifier_keeps_nothing_of_other_operators(spark):
    from tablepact.llm import quality_classifier, tokens
    before = tokens.worker_tokenizer(tokens.default_tokenizer())
    ran = []

    class Table:
        def select(self, *_):
            return self

        groupBy = applyInPandas = select  # noqa: N815

        def mapInArrow(self, run, _):  # noqa: N802
            ran.extend(run(iter([])))
            return self

        def collect(self):
            return []
    quality_classifier.moments(Table(), "group")
    assert len(ran) == 1 and tokens.worker_tokenizer(tokens.default_tokenizer()) is not before
