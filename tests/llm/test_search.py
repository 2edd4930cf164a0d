"""URL filter, hard negatives and ranked search against plain versions, and their odd inputs."""

import itertools
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandlake.llm import negatives, queries, treap, urltree
from strandlake.session import Scratch, seen_by, session_with

DATA = Path("/root/testdata/sf0.001")
RULES = [urltree.Rule.parse(x) for x in queries.URL_RULES]


# --- url filter -----------------------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    bare = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = bare.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)


def shape_of(path, depth):
    out = []
    for s in path.split("/")[1:]:
        base, ext = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s, re.DOTALL).groups()
        if re.fullmatch("[0-9]+", base):
            base = "{n}"
        elif re.fullmatch("[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", base):
            base = "{d}"
        elif re.fullmatch("[0-9a-f-]{8,}", base) and re.match("[a-f-]*[0-9]", base):
            base = "{x}"
        out.append(base + (ext or ""))
    return tuple(out[:depth] + ["**"] * (len(out) > depth))


def kind(segment):
    if not segment:
        return "end"
    bare = re.sub(r"\.[A-Za-z]{1,5}$", "", segment)
    return bare if bare in ("{n}", "{d}", "{x}", "**") else "mixed" if re.search("[0-9]", bare) else "word"


def plain_tree(urls, s):
    """{(host, shape): (template, share, labelled)} in plain Python."""
    n, bad, labelled = Counter(), Counter(), Counter()
    for u in urls:
        host, path = split_url(u)
        key, rule = (host, shape_of(path, s.depth)), plain_rule(host, path)
        n[key] += 1
        labelled[key] += rule is not None
        bad[key] += rule is not None and rule.block
    prior = (sum(bad.values()) + 0.5) / (sum(labelled.values()) + 1) if sum(labelled.values()) else 0.5

    def smooth(keys, p):
        return (sum(bad[k] for k in keys) + s.strength * p) / (sum(labelled[k] for k in keys) + s.strength)

    state = {}
    for host in {h for h, _ in n}:
        own = [k for k in n if k[0] == host]
        for k in own:
            state[k] = (host, smooth(own, prior), sum(labelled[x] for x in own))
    for level in range(s.depth + 1):
        nodes = defaultdict(lambda: defaultdict(list))
        for k in n:
            if len(k[1]) > level:
                nodes[state[k][0]][k[1][level]].append(k)
        for node, children in nodes.items():
            p = state[next(iter(children.values()))[0]][1]
            every = [k for own in children.values() for k in own]
            total = sum(n[k] for k in every)
            if len(children) > s.max_children or (len(children) >= s.few and len(children) >= s.distinct * total):
                for k in every:
                    state[k] = (f"{node}/*", smooth(every, p), sum(labelled[x] for x in every))
                continue
            kinds = {c: Counter() for c in children}
            for c, own in children.items():
                for k in own:
                    kinds[c][kind(k[1][level + 1] if len(k[1]) > level + 1 else None)] += n[k]
            pool = sum(kinds.values(), Counter())
            df, groups = len(pool) - 1, defaultdict(list)
            for c in children:
                own = sum(kinds[c].values())
                chi = sum((kinds[c][x] - own * pool[x] / total) ** 2 / (own * pool[x] / total) for x in pool)
                bound = df * (1 - 2 / (9 * df) + s.z_kinds * math.sqrt(2 / (9 * df))) ** 3 if df else 0
                lab = sum(labelled[k] for k in children[c])
                groups[("alone", c) if df and chi > bound else "labelled" if lab else "unlabelled"].append(c)
            clusters = [[x] for key, own in groups.items() if key[0] == "alone" for x in own]
            runs, last = [], None
            lab = {c: sum(labelled[k] for k in children[c]) for c in children}
            hit = {c: sum(bad[k] for k in children[c]) for c in children}
            for c in sorted(groups["labelled"], key=lambda c: (hit[c] / lab[c], c)):
                share, size = (hit[c] + 0.5) / (lab[c] + 1), lab[c] + 1
                error = share * (1 - share) / size
                if last is None or abs(share - last[0]) > s.z_labels * math.sqrt(error + last[1]):
                    runs.append([])
                runs[-1].append(c)
                last = (share, error)
            if len(runs) == 1:
                runs[0] += groups["unlabelled"]
            elif groups["unlabelled"]:
                runs.append(groups["unlabelled"])
            for own in clusters + runs:
                token = own[0] if len(own) == 1 else f"({min(own)}|+{len(own) - 1})"
                keys = [k for c in own for k in children[c]]
                for k, v in [(k, (f"{node}/{token}", smooth(keys, p), sum(labelled[x] for x in keys))) for k in keys]:
                    state[k] = v
    return state


def plain_verdicts(urls, s):
    state = plain_tree(urls, s)
    for u in urls:
        host, path = split_url(u)
        rule = plain_rule(host, path)
        template, share, labelled = state[(host, shape_of(path, s.depth))]
        block = rule.block if rule else labelled > 0 and share >= s.reject
        yield host, path, rule and rule.name, "block" if block else "allow", template, share


def check_urls(spark, urls, s=urltree.TreeSettings()):
    rows = list(enumerate(urls))
    got = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES, settings=s).orderBy("page_id").collect()
    want = list(plain_verdicts(urls, s))
    assert len(got) == len(urls)
    for g, w in zip(got, want):
        assert (g.host, g.path, g.rule, g.verdict, g.template) == w[:5]
        assert g.blocked_share == pytest.approx(w[5], abs=1e-12)
    return got


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_url_query_equals_plain_version(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    got = check_urls(spark, urls)
    assert {g.verdict for g in got if g.rule is None} == {"allow", "block"}


def test_urls_of_all_kinds(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://ÄB.com/en/", "http://a.net/es", "http://a.net/es/?q=/fr/", "x://net/fr/a#b", "http://evilcom/", "http://a.com?x=://b/", "http://h.org//", "http://h.org/" + "a/" * 500, "http://h.org/" + "x" * 20_000]
    slugs = [f"http://shop.net/{a}/item-{i}-{'abc'[i % 3]}x" for a, i in itertools.product(("es", "fr", "en", "de"), range(30))]
    dates = [f"http://blog.example.com/{lang}/2024-0{i % 9 + 1}-11/deadbeef{i:02d}.html" for lang in ("en", "de", "es") for i in range(20)]
    names = [f"http://u.example.com/user{'q' * i}/profile" for i in range(1, 12)]
    check_urls(spark, odd + slugs + dates + names + odd + slugs[:7])
    check_urls(spark, ["http://a.org/x/1", "http://a.org/y/2"])
    wild = {g.template for g in check_urls(spark, names)}
    assert wild == {"u.example.com/*/profile"}


def test_urls_learn_from_siblings(spark):
    """Pages beside others that rules block are blocked, those beside allowed and blocked ones are not, nor unknown hosts."""
    urls = [f"http://bad.net/{x}/{i}" for x in ("es", "fr") for i in range(40)] + [f"http://good.org/{x}/{i}" for x in ("es", "en") for i in range(40)]
    rows = {g.page_id: g for g in check_urls(spark, [*urls, "http://bad.net/en/7", "http://bad.net/about.html"])}
    assert rows[160].verdict == "block" and rows[161].verdict == "allow" and rows[100].verdict == "allow"


def test_urls_without_rows_and_with_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, Verdict int, `a.b` string")
    assert urltree.judge(empty, RULES).collect() == []
    one = spark.createDataFrame([(None, "http://x.com/", 3, "z", {"k": "v"})] * 2, "page_id long, url string, Verdict int, `a.b` string, m map<string,string>")
    got = urltree.judge(one, RULES)
    assert got.columns == ["page_id", "url", "a.b", "m", "host", "path", "rule", "verdict", "template", "blocked_share", "template_labelled"]
    assert [(r.verdict, r["a.b"]) for r in got.collect()] == [("allow", "z")] * 2


# --- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows):
    ok = [(i, l, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in ok:
        if a is None or a % 100:
            continue
        last = lambda i: math.inf if i is None else i
        same = sorted(((-int(va @ v), last(i), i) for i, l, v in ok if l == la and i != a), key=lambda x: x[:2])[:5]
        other = sorted(((-int(va @ v), last(i), i) for i, l, v in ok if l != la), key=lambda x: x[:2])
        for p, _, i in same:
            fit = [(-s, j) for s, _, j in other if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, i, k + 1, j, -p, s) for k, (s, j) in enumerate(fit)]
    return out


def key(row):
    return tuple(math.inf if x is None else x for x in row)


@pytest.mark.parametrize("n, dims, block", [(300, 5, 8), (700, 16, 32), (40, 1, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dims, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "GROUP", 2)
    monkeypatch.setattr(negatives, "PAGE", 3)
    draw = np.random.default_rng(n)
    middles = draw.normal(size=(6, dims))
    rows = [(int(i), int(draw.integers(4)), [float(x) for x in middles[draw.integers(6)] + draw.normal(size=dims) * 0.2]) for i in range(n)]
    # a third are copies of one vector; ids repeat, labels and vectors are missing or not finite
    rows += [(1000 + i, i % 4, rows[0][2]) for i in range(n // 3)]
    rows += [(1100, 1, rows[1][2]), (None, 2, rows[2][2]), (200, None, rows[0][2]), (5, 1, None), (6, 1, [None] * dims), (7, 1, [math.nan] * dims), (8, 1, [math.inf] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_negatives(rows)))


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>, Score string"
    anchor = F.col("vec_id") % 100 == 0
    assert negatives.mine(spark.createDataFrame([], schema), anchor).collect() == []
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0], "x"), (100, 2, [1.0], "x"), (1, 1, [], "x")], schema), anchor).collect() == []
    big = spark.createDataFrame([(100, 1, [3e38, 1.0], "x"), (1, 1, [2.0], "x"), (2, 2, [1.9, 0.5], "x")], schema)
    top = negatives.LARGEST
    assert [tuple(r) for r in negatives.mine(big, anchor).collect()] == [(100, 1, 1, 2, top * 512, top * 486 + 256 * 128)]


def test_hilbert_curve_visits_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_every_product():
    draw = np.random.default_rng(3)
    a, v = draw.integers(-300, 300, (9, 12)), draw.integers(-300, 300, (50, 12))
    least, most = negatives.intervals(a, v.min(axis=0)[None], v.max(axis=0)[None])
    assert (least <= a @ v.T).all() and (a @ v.T <= most).all()
    huge = np.full((1, 64), negatives.LARGEST)
    assert negatives.products(huge, huge)[0, 0] == 64 * negatives.LARGEST**2


# --- ranked search --------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(items, docs, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in Counter(plain_terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return out


def check_search(spark, items, docs, k=20, chunk=512):
    scratch = Scratch()
    found = treap.index(spark.createDataFrame(docs, "doc_id long, text string, Score string").repartition(4), scratch)
    got = treap.search(spark.createDataFrame(items, "item_id long, text string, rank int"), found, scratch, k=k, chunk=chunk)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(key, got.collect())) == sorted(map(key, plain_search([x[:2] for x in items], [x[:2] for x in docs], k)))


@pytest.mark.parametrize("words, n, run_bytes", [(30, 400, 2_000), (3_000, 300, 20_000), (8, 60, 10**9)])
def test_search_equals_brute_force(spark, monkeypatch, words, n, run_bytes):
    monkeypatch.setattr(treap, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(treap, "BEAM", 4)
    draw = np.random.default_rng(words)
    chance = 1 / np.arange(1, words + 1)
    text = lambda size: " ".join(f"w{x}" for x in draw.choice(words, size, p=chance / chance.sum()))
    docs = [(i, text(int(draw.integers(1, 120))), "x") for i in range(n)]
    # a third are copies, ids repeat, some are missing
    docs += [(n + i, docs[0][1], "x") for i in range(n // 3)] + [(3, docs[5][1], "x"), (None, docs[0][1], "x"), (None, docs[2][1], "x")]
    items = [(i, text(12), 1) for i in range(20)] + [(0, docs[0][1], 1), (None, docs[1][1], 1)]
    check_search(spark, items, docs)
    check_search(spark, items, docs, k=3, chunk=5)


def test_search_of_odd_texts(spark, odd_texts):
    docs = [(i, t, "x") for i, t in enumerate([*odd_texts, "İ ı ß É é", "a_b-c.d", "\0x\x7fy", "W " * 30_000])]
    items = [(i, t, 1) for i, t in enumerate([*odd_texts, "É é WORD y", "w", "nothing of these", "a b c d a"])]
    check_search(spark, items + items[:3], docs)
    check_search(spark, items, [])
    check_search(spark, [], docs)
    check_search(spark, items, [(1, None, "x"), (2, "...", "x")])


def test_pyramids_hold_the_maxima():
    words, doc_of = treap.terms_of(["a b b c", "c d", "", "a a a a", "e " * 40])
    row = treap.build(words, doc_of, np.arange(5), 4, 50)
    found = treap.Treap(row)
    for above, below, masks in zip(found.tops, found.tops[1:], found.masks):
        ends = np.cumsum(treap._SET_BITS[masks])
        assert len(below) == ends[-1]
        assert [int(below[a:b].max()) for a, b in zip([0, *ends[:-1]], ends)] == above.tolist()


def test_ranked_search_holds_one_run_at_a_time(spark):
    docs = spark.range(3).select(F.concat(F.repeat(F.lit("word "), 500_000), F.col("id").cast("string")).alias("text"), F.col("id").alias("doc_id")).coalesce(1)
    scratch = Scratch()
    made = treap.index(docs, scratch)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.runs.inputFiles()]
    assert [(m.num_rows, m.num_row_groups) for m in files] == [(3, 3)]
    own, before = session_with(spark, **treap.ONE_A_BATCH), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = seen_by(own, made.runs).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert [r.n for r in sizes] == [1, 1, 1] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    items = spark.createDataFrame([(7, "1 word")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in treap.search(items, made, scratch).orderBy("rank").collect()] == [(1, 1), (2, 0), (3, 2)]
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
