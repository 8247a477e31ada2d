"""Urls of many levels: one long path costs its length, and nodes with many children at several levels are all generalised."""

from lodestone.llm import urls

PAGES, LABELS = "page_id long, url string", "page_id long, good boolean"


def judged(spark, rows, labels):
    out = urls.judge_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), rules=(("none.invalid", "/", "allow"),))
    return {r.page_id: r for r in out.collect()}


def test_one_url_of_thousands_of_levels(spark):
    deep = "/".join("ab"[i % 2] for i in range(3000))
    rows = [(i, f"http://h.org/s{i % 2}/x{i}") for i in range(40)] + [(100, f"http://h.org/{deep}"), (101, "http://h.org" + "/" * 5000), (102, f"http://h.org/{deep}/c")]
    out = judged(spark, rows, [(i, i % 2 == 0) for i in range(40)])
    assert {out[i].verdict for i in range(40) if i % 2} == {"block"} and {out[i].verdict for i in range(40) if i % 2 == 0} == {"allow"}
    assert out[100].template == f"/{deep}" and out[101].template == "/" and out[102].template == f"/{deep}/c"


def test_rounds_follow_wide_nodes_not_levels(spark, monkeypatch):
    rounds, real = [], urls._places
    monkeypatch.setattr(urls, "_places", lambda tree: rounds.append(1) or real(tree))
    rows = [(i, "http://h.org/" + "/".join(f"d{k}" for k in range(30)) + f"/f{i}") for i in range(5)]
    judged(spark, rows, [(0, True)])
    assert len(rounds) == 1
    rounds.clear()
    wide = [(i * 40 + j, f"http://h.org/a/v{chr(97 + i % 26)}{i}q/b/w{chr(97 + j % 26)}{j}q") for i in range(40) for j in range(40)]
    out = judged(spark, wide, [(0, True)])
    assert len(rounds) == 3 and {r.template for r in out.values()} == {"/a/*/b/*"}


def test_many_labels_keep_a_name_below_a_wide_node(spark):
    rows = [(i, f"http://h.org/u{chr(97 + i % 26)}{i}z/p") for i in range(60)] + [(1000 + i, f"http://h.org/bad/p{i}") for i in range(30)]
    out = judged(spark, rows, [(i, True) for i in range(60)] + [(1000 + i, False) for i in range(30)])
    assert out[0].template == "/*/p" and out[0].verdict == "allow" and out[1000].template.startswith("/bad/") and out[1000].verdict == "block"
