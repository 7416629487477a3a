import re

from corvida.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r, _ in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme/net/", "http://a.net", "http://a.net/", "https://EXAMPLE.net/en/x?y#z", "http://www.example.NET/en", "http://notexample.net/en/",
    "http://example.com/de/1", "http://m.example.com/en/?de/", "http://x.org/fr/", "http://x.org/de/", "ftp://net/x", "http://x.org?u=http://y.net/", "http://knet/", "a\nb://h.net/p",
    "://x.net/", "http://É.example.com/de/", "http:///en/", "http://x.net:80/",
]


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i % 15, u, "<p>", "h") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule or "") for r in urlfilter.judge(pages).collect()))
    assert got == sorted((i % 15, *parts(u), rule(*parts(u)) or "") for i, u in enumerate(URLS))
    assert urlfilter.judge(pages.limit(0)).count() == 0


def brute_scores(edges, hosts, trusted, blocked, d=urlfilter.DAMPING):
    """Power iteration to the fixpoint; what a host without a way on holds goes back to the seeds."""
    hosts = sorted(hosts)

    def rank(ways, seeds):
        if not seeds & set(hosts):
            return dict.fromkeys(hosts, 0.0)
        seeds = {h: (h in seeds) / len(seeds & set(hosts)) for h in hosts}
        out = {}
        for (a, _), n in ways.items():
            out[a] = out.get(a, 0) + n
        x = dict(seeds)
        for _ in range(400):
            stuck = sum(x[h] for h in hosts if h not in out)
            y = {h: (1 - d + d * stuck) * seeds[h] for h in hosts}
            for (a, b), n in ways.items():
                y[b] += d * n / out[a] * x[a]
            x = y
        return x

    return rank(edges, trusted), rank({(b, a): n for (a, b), n in edges.items()}, blocked)


def test_propagation_against_brute_force(spark):
    links = {
        "a.org": ["http://b.com/", "//c.com/x", "/own", "b.com"],
        "b.com": ["http://c.com/1", "HTTP://C.com/2"],
        "d.com": ["http://bad.net/", "http://bad.net/2", "http://b.com"],
        "e.com": ["http://d.com/"],
        "c.com": ["http://d.com/?u=http://bad.net"],
        "f.com": [],
    }
    pages = spark.createDataFrame([(i, f"http://{h}/page", "".join(f'<a HREF = "{x}">' if k % 2 else f"<a href={x}>" for k, x in enumerate(ls))) for i, (h, ls) in enumerate(links.items())] + [(9, "http://g.com/", None)], "page_id long, url string, html string")
    edges = {}
    for h, ls in links.items():
        for x in ls:
            if "//" in x:
                to = parts("http:" + x if x.startswith("//") else x)[0]
                if to and to != h:
                    edges[h, to] = edges.get((h, to), 0) + 1
    found = {(r.src, r.dst): r.n for r in urlfilter.host_edges(pages).collect()}
    assert found == edges
    hosts = set(links) | {b for _, b in edges} | {"g.com"}
    trust, distrust = brute_scores(edges, hosts, {"a.org"}, {"bad.net"})
    rows = urlfilter.host_scores(urlfilter.host_edges(pages), spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    got = {r.host: (r.trust, r.distrust) for r in rows}
    for h in hosts:
        t, b = got.get(h, (0.0, 0.0))
        assert abs(t - trust[h]) < 1e-8 and abs(b - distrust[h]) < 1e-8
    verdicts = {r.host: r.verdict for r in urlfilter.judge(pages).collect()}
    assert verdicts == {h: "block" if distrust[h] > trust[h] else "allow" for h in verdicts}
    assert verdicts["d.com"] == "block" and verdicts["b.com"] == "allow" and verdicts["f.com"] == "allow"


def test_a_chain_of_any_length_and_the_sql(spark, tmp_path):
    import duckdb

    from corvida.llm import queries

    hosts = [f"h{i}.com" for i in range(15)] + ["bad.net"]
    rows = [(i, f"http://{a}/", f"<!-- <a href='http://x.org/'> --><a href='http://{b}/'>") for i, (a, b) in enumerate(zip(hosts, hosts[1:]))]
    # two hosts that link to each other, one of them to a blocked host too, and trust that outweighs distrust
    rows += [(20, "http://p.com/", "<a href=http://q.com/><a href=http://bad.net/>"), (21, "http://q.com/", "<a href=http://p.com/>"), (22, "http://good.org/", "<a href=http://r.com/>"), (23, "http://r.com/", "<a href=http://bad.net/>"), (24, "http://long.com/", "x" * 300_000 + "<a href=http://q.com/>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in urlfilter.judge(pages).collect()}
    assert all(verdicts[h] == "block" for h in hosts[4:15]) and verdicts["p.com"] == verdicts["q.com"] == verdicts["long.com"] == "block"
    assert verdicts["r.com"] == "allow"
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.SQL["op6_url_filter"]).df()
    assert dict(zip(want["host"], want["verdict"])) == verdicts
    alone = spark.createDataFrame(rows[:15], "page_id long, url string, html string")
    assert {r.verdict for r in urlfilter.judge(alone).collect()} == {"block"}
