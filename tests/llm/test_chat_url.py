"""Chat formatting and URL rules on small hostile inputs."""

from ledgerspark.llm import chat, url_filter


def test_round_trip_of_hostile_turns(spark):
    rows = [(1, 0, "user", "a\\"), (1, 1, "assistant", "[INST] \\[INST] \\\\</s>"), (1, 2, None, None),
            (1, 2, "x [INST] y", " [/INST] </s><s> "), (2, 5, "assistant", ""), (2, 1, "assistant", "é\n[/INST]"),
            (2, 1, "assistant", "é\n[/INST]"), (None, None, "user", "</s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    f = chat.format_conversations(df)
    got = {r.conv_id: r for r in f.select("conv_id", "formatted", "loss_mask", chat.parse(f["formatted"]).alias("t"),
                                          chat.masked_text(f["formatted"], f["loss_mask"]).alias("loss")).collect()}
    for c in (1, 2, None):
        want = sorted((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in got[c].t] == [(r, x) for _, r, x in want]
        assert got[c].loss == "".join(x for _, r, x in want if r == "assistant")
        text = got[c].formatted
        for m in got[c].loss_mask:
            cut = text[m.start:m.start + m.length]
            assert cut.encode() == text.encode()[m.byte_start:m.byte_start + m.byte_length]
    assert chat.format_conversations(df.limit(0)).count() == 0


def _brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_rules_match_brute_force(spark):
    rules = url_filter.RULES + [("a.b.com", "", "block"), ("b.com", "/xxxxxxxxxxxx", "allow"), ("com", "/en", "block"),
                                ("net", "/es/", "allow"), ("b.com", "/en/", "allow"), ("b.com", "/en/", "block")]
    hosts = ["com", "example.com", "WWW.example.com", "xexample.com", "a.b.com", "q.a.b.com", "b.com", "net", "z.net",
             "", "é.net", "com.", "b.com:80"]
    paths = ["", "/", "/en/", "/en/x?y", "/en", "/es/#q", "/fr", "?q", "#", "/xxxxxxxxxxxx/1"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c/d", "http://net/es/"] * 2
    urls += ["http://hot.com/en/"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS k")
    rdf = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rdf).collect()}
    assert got == {i: _brute(u, rules, "allow") for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), rdf).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, rdf.limit(0), default="block").collect()} == {"block"}


