import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.llm.queries import QUERIES
from vigil.llm.url_filter import ALLOWED_HOSTS, ALLOWED_PATHS, BLOCKED_HOSTS, BLOCKED_PATHS, RULES, filter_urls, fit_urls, labelled_urls

SCHEMA = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def rule_for(host, path, rules=RULES):
    fits = []
    for verdict, name in rules:
        own, start = name[: name.index("/")], name[name.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            fits.append((len(name), len(own), verdict == "block", name, verdict))
    return max(fits)[3:] if fits else (None, None)


def check(rows, model, rules=RULES):
    for r in rows:
        host, path = parts(r.url)
        rule, verdict = rule_for(host, path, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or ("block" if model.score(host, path) >= 0.5 else "allow"))


ODD = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.Net/x", "http://a.net", "http://a.net?q=/", "http://a.net#/", "https://m.example.net/en/1?x#y",
    "https://example.net/en", "https://badexample.net/en/1", "https://example.com/de/9", "https://x.example.com/de/", "https://example.org/fr/", "https://ÉCOLE.org/fr/É",
    "a://b://c/d", "http://org/fr/", "://net/", "http://user@x.net:80/", "http://x.com/" + "p" * 100_000, "http://x.com/a\nb?c", "http://x.com/a\nb?c", "http:///path",
]


@pytest.fixture(scope="module")
def model(spark):
    return fit_urls(labelled_urls(spark))


def test_odd_urls(spark, model):
    df = spark.createDataFrame(list(enumerate(ODD)) + [(None, "http://a.net/")], SCHEMA)
    rows = filter_urls(df, model).collect()
    assert len(rows) == len(ODD) + 1
    check(rows, model)


def test_equally_long_rules(spark, model):
    rules = [("allow", "b.com/x/"), ("block", "com/xyzw"), ("block", "a.b.com/"), ("allow", "com/x")]
    urls = ["http://b.com/x/", "http://a.b.com/x/", "http://b.com/xyzw", "http://c.com/x"]
    check(filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), model, rules).collect(), model, rules)


def test_query_over_all_pages(spark, model):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = QUERIES["op9_url_ngrams"](spark, SF_SMALL)
    pages = spark.createDataFrame(list(urls.items()), SCHEMA)
    joined = rows.join(pages, "page_id").collect()
    assert len(joined) == len(urls)
    check(joined, model)


def plain_model(rows, rounds=300, ridge=1e-4, share=0.2):
    """Logistic regression with momentum on a dense matrix of the hashed n-grams; returns its score function."""
    def found(host, path):
        grams = {k + t[i : i + n] for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        return {xxhash.xxh64_intdigest(g) % 65536 for g in grams}

    each = [found(*parts(url)) for url, _ in rows]
    column = {c: k for k, c in enumerate(sorted(set().union(*each)))}
    x, y = np.zeros((len(rows), len(column))), np.array([label for _, label in rows], float)
    for k, cells in enumerate(each):
        x[k, [column[c] for c in cells]] = len(cells) ** -0.5
    worth = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    w, b, dw, db = np.zeros(len(column)), 0.0, np.zeros(len(column)), 0.0
    for _ in range(rounds):
        e = worth * (y - 1 / (1 + np.exp(-(x @ w + b))))
        dw, db = 0.9 * dw + 4 * (x.T @ e - ridge * w), 0.9 * db + e.sum()
        w, b = w + dw, b + db

    def score(host, path):
        cells = found(host, path)
        return 1 / (1 + np.exp(-(sum(w[column[c]] for c in cells if c in column) / max(len(cells), 1) ** 0.5 + b)))

    return score


def test_scores_equal_a_plain_model(spark, model):
    plain = plain_model([tuple(r) for r in labelled_urls(spark).collect()])
    urls = [r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()] + [u for u in ODD if u is None or len(u) < 100]
    for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), model).collect():
        assert r.score == pytest.approx(plain(*parts(r.url)), abs=1e-9)
        assert r.rule or r.verdict == ("block" if plain(*parts(r.url)) >= 0.5 else "allow")


def test_the_table_names_no_host_of_the_pages(spark):
    """Neither hosts nor the words that make the blocked ones."""
    given = {parts(r.url)[0] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    own = {h.rsplit(".", 1)[0] for h in BLOCKED_HOSTS + ALLOWED_HOSTS}
    assert not {h.split(".")[k] for h in given for k in range(h.count(".") - 1)} & own


def auc(held, model):
    scores = [(label, model.score(*parts(url))) for url, label in held]
    block, allow = [s for y, s in scores if y], [s for y, s in scores if not y]
    return sum((b > a) + (b == a) / 2 for b in block for a in allow) / (len(block) * len(allow))


@pytest.mark.parametrize("by", ["host", "path"])
def test_held_out_urls(spark, by):
    """Split by host (the path tells nothing of allowed paths' hosts) and by path."""
    rows = [tuple(r) for r in labelled_urls(spark).collect()]
    names = BLOCKED_HOSTS + ALLOWED_HOSTS if by == "host" else BLOCKED_PATHS + ALLOWED_PATHS
    total = 0
    for fold in range(4):
        out = {n for k, n in enumerate(names) if k % 4 == fold}
        part = [(any(parts(u)[0].endswith(h) for h in out) if by == "host" else parts(u)[1] in out) for u, _ in rows]
        model = fit_urls(spark.createDataFrame([r for r, p in zip(rows, part) if not p], "url string, label int"))
        total += auc([r for r, p in zip(rows, part) if p], model) / 4
    assert total > 0.8


def test_labels_are_learnt_and_odd_tables_fit(spark, model):
    rows = [tuple(r) for r in labelled_urls(spark).collect()]
    assert all((model.score(*parts(u)) >= 0.5) == bool(label) for u, label in rows)
    assert model.score("neutral.test", "/casino/win-free-prize") >= 0.5 and model.score("neutral.test", "/en/101") < 0.5
    for rows in ([], [("http://a.b/", None)], [("http://a.b/", 0), (None, 0)]):
        assert fit_urls(spark.createDataFrame(rows, "url string, label int")).score("a.b", "/") < 0.5
    assert fit_urls(spark.createDataFrame([("http://a.b/", 1)], "url string, label int")).score("a.b", "/") > 0.5


def test_empty_table_and_clashing_columns(spark, model):
    assert filter_urls(spark.createDataFrame([], SCHEMA), model).collect() == []
    df = spark.createDataFrame(list(enumerate(ODD)), SCHEMA).withColumns({"HOST": F.lit(1), "rule": F.lit(2), "label": F.lit(3)})
    out = filter_urls(df, model)
    check(out.collect(), model)
    assert "label" in out.columns and "HOST" not in out.columns
