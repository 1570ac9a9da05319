"""The budgets of the leaves are computed once for all parts of a selection that read them."""

from tessera.llm import mixing


def test_budgets_are_made_once(spark):
    docs = spark.createDataFrame([(k, "a b c " * (1 + k % 5), "abc"[k % 3], "xy"[k % 2], f"s{k % 4}") for k in range(200)], "doc_id long, text string, domain string, lang string, source string")
    picked = mixing.mix(docs, ["domain", "lang", "source"], max_epochs=3, share_of_corpus=1.5)
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    # a running sum over bins (twice, as a budget ends in one of them), one within a bin, and none for the tree's levels
    assert plan.count("Window [") <= 5
    rows = picked.collect()
    assert sum(r["tokens"] for r in rows) <= 1.5 * sum(3 * (1 + k % 5) for k in range(200))
    assert all(sum(r["tokens"] for r in rows if (r["domain"], r["lang"], r["source"]) == leaf) <= budget for leaf, budget in {((r["domain"], r["lang"], r["source"])): r["budget"] for r in rows}.items())
