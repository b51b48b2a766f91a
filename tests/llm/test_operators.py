"""Operators against brute force on a small table with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terragrid.llm import decontaminate, html_wrappers, jaccard_join, line_dedup, mixing, pii, quality_rules, sketch, substring_dedup, token_files, warc, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus():
    r = random.Random(3)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    common = text(60)
    rows = [(None, "null id", "s1"), (1, None, "s1"), (2, "", None), (3, " \n\t ", "s2"), (4, "one", "s1"), (5, text(4000), "s3")]
    base = text(200).split()
    for i in range(40):
        near = list(base)
        for _ in range(i % 9):
            near[r.randrange(200)] = r.choice(vocabulary)
        rows.append((10 + i, " ".join(near), "s1"))
    rows += [(100 + i, f"{text(30)}\n{common}\n{text(30)}", f"s{i % 5}") for i in range(20)]
    rows += [(200 + i, text(r.randrange(1, 90)), "s2") for i in range(60)]
    rows += [(7, "same row twice here and here", "s1")] * 2
    rows += [(150, common, "s1")] * 3
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in corpus()], "doc_id long, text string, source string, `odd name` string, n_words int").repartition(5)


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", [None, 12])
def test_sketch(spark, monkeypatch, limit):
    """Levels are never too low, and few single hashes are taken for repeated ones, also where blocks are at their limit and chunks grow."""
    import numpy as np

    if limit:
        monkeypatch.setattr(sketch, "MAX_BLOCK", limit)
        monkeypatch.setattr(sketch, "MIN_BLOCK", 8)
        monkeypatch.setattr(sketch, "BLOCKS", 3)
    n, items = 40_000, 400_000
    docs = spark.range(10 * n).select(F.concat_ws(" ", F.col("id"), F.lit("often"), F.pmod("id", F.lit(n)) + 10 * n).alias("t")).repartition(10)
    held = sketch.Sketch(items, (2, 16))
    held.chunk = 100_000
    chunks = sketch.chunked(docs, "t", held)
    sizes = [len(sketch.texts_of(sketch.rows_of(r.data), "t")) for r in chunks.collect()]
    assert sum(sizes) == 10 * n and max(sizes) < 100_000
    hashes = lambda rows: words.Words(sketch.texts_of(rows, "t")).hash

    def look(batch_iter):
        import pyarrow as pa

        for _, rows, told in sketch.each_chunk(batch_iter):
            level = held.levels(hashes(rows), told)
            yield pa.RecordBatch.from_arrays([pa.array(level[i::3]) for i in range(3)], ["one", "often", "tenth"])

    told = sketch.with_levels(chunks, hashes, held).mapInArrow(look, "one byte, often byte, tenth byte")
    got = told.agg(F.avg((F.col("one") > 0).cast("int")).alias("let"), F.min("often").alias("often"), F.min("tenth").alias("tenth")).first()
    assert got.let < 0.3 and got.often == 2 and got.tenth >= 1
    values = np.array([0, 5, 127, 128, 1 << 12])
    assert all((sketch.unpack(sketch.pack(values, low), low, 5) == values).all() for low in (1, 4, 9))


def test_substring_dedup(docs):
    count = collections.Counter()
    for _, t, _ in corpus():
        w = SPACED.findall(t or "")
        count.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = collections.Counter()
    for i, t, _ in corpus():
        w = SPACED.findall(t or "")
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert bag(substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")) == want


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, k, percent):
    rows = [r for r in corpus()]
    sets = []
    for _, t, _ in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)].append(r[0])
    want = collections.Counter((r[0], len(sets[i]), min(low[top(i)], default=None)) for i, r in enumerate(rows))
    assert bag(jaccard_join.linked_components(docs, "doc_id", "text", k, percent)) == want
    kept = jaccard_join.keep_one(docs, k=k, percent=percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({top(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


@pytest.mark.parametrize(("k", "percent", "hot"), [(3, 60, 32), (3, 90, 32), (3, 90, 2), (3, 60, 5)])
def test_jaccard_links(spark, docs, monkeypatch, k, percent, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4 * hot)
    rows = corpus()
    sets = []
    for _, t, _ in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    link = lambda a, b: bool(a) and len(a & b) * 100 >= len(a | b) * percent
    want = collections.Counter((r[0], sum(link(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, r in enumerate(rows))
    got = jaccard_join.linked(docs, "doc_id", "text", k, percent)
    assert bag(got.select("doc_id", "n_links")) == want
    assert bag(got.drop("n_links")) == bag(jaccard_join.linked_components(docs, "doc_id", "text", k, percent))


def test_decontaminate(spark, docs):
    texts = [t for _, t, _ in corpus()]
    items = [("b", texts[8]), ("a", "ONE"), (None, " ".join(texts[-1].split()[5:30])), ("c", None), ("d", "...")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i or "")
    want = collections.Counter()
    for i, t, _ in corpus():
        w = pattern.findall(lower(t))
        hit, found = set(), set()
        for x, ids in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found |= ids
        want[(i, len(w), len(hit), ",".join(sorted(found)))] += 1
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_matches(docs, bench)
    assert bag(got.select("doc_id", "n_words", "n_hit", F.array_join("items", ","))) == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for (_, _, hit, _), n in want.items() if not hit)
    assert decontaminate.find_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_repeated_words(spark):
    """One word again and again on both sides: the work stays with the words; two blocks of items give what one does."""
    import time

    block = lambda n, i="a": decontaminate.Block([i], [b"w " * n], 10)
    start = time.time()
    n, spans, items, top = decontaminate.matches_in([b"x " + b"w " * 40_000, b"w " * 9], [block(500), block(3, "b")])
    assert time.time() - start < 20
    assert (n.tolist(), spans, items, top.tolist()) == ([40_001, 9], [[(1, 40_000)], [(0, 9)]], [{"a", "b"}, {"b"}], [500, 3])
    none = spark.createDataFrame([], "doc_id long, text string, longest int")
    assert decontaminate.find_matches(none, spark.createDataFrame([("a", "b")], "item_id string, text string")).count() == 0


def test_suffix_array():
    import numpy as np

    rank = np.array([3, 1, 2, 1, 2, 0, 3, 1, 2, 0])
    sa = decontaminate.suffix_array(rank, 8)
    depth = lambda i: tuple(rank[i:].tolist() + [0] * 10)[:3]
    assert [depth(i) for i in sa if rank[i]] == sorted(depth(i) for i in sa if rank[i])


def test_quality_rules(spark, docs):
    """All counts and verdicts against plain Python, line by line."""
    rows = [(1, None), (2, ""), (3, "\n".join(f"Line {i} has w{i} x{i} y{i} z{i} in it." for i in range(5))), (4, " ".join(["spam"] * 50)), (5, "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(9))), (6, "few words"), (7, "x y z\nx y z\n\nx y z")]
    rows += [(8, "Startseite\n Accueil \n» Leer más\nAlle Rechte vorbehalten.\nIn the anzeigen.\nPágina no encontrada!\n(SEARCH)"), (9, "A heading\n" + " ".join(f"Satz Nummer {i} ist da." for i in range(9)) + "\n\nno end of it in sight\nWow!! so!! loud!! this.\n\t#$% é\n$$ a b c d e f g h i j."), (10, "x\x0by\x0cz é\u00a0ü\u2003q " * 3 + "\n" + "same eight words in a row here twice " * 2)]
    rows += [(100 + i, t) for i, (_, t, _) in enumerate(corpus())]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, __facts string, n_words int")
    got = {r.doc_id: r for r in quality_rules.measure(frame).collect()}
    assert [got[i].kept for i in range(1, 8)] == [False, False, True, False, False, False, False]
    assert (got[4].n_repeat_words, got[7].n_dup_lines, got[5].n_bad_lines) == (50, 2, 9)
    assert got[8].n_bad_lines == 6 and got[9].n_bad_lines == 3 and got[9].kept and got[9].clean_text.startswith("A heading\nSatz")
    java = lambda p: re.compile(p.replace(r"\p{L}\p{N}", r"\w"))
    for i, t in rows:
        w, lines = SPACED.findall(t or ""), (t or "").split("\n")
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeat = len({k for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)})
        bad = []
        for x in lines:
            n, solid = len(SPACED.findall(x)), sum(map(len, SPACED.findall(x)))
            shout = n >= 3 and sum(x.count(c) for c in "!?") * 3 > 2 * n and len(re.findall(r"[!?]{2,}", x)) * 3 > n
            many = lambda chars: sum(x.count(c) for c in chars)  # noqa: B023, E731
            bad.append(n > 0 and bool(many("#*$%&|<>") * 5 > solid or many("|>»•") * 3 >= n or shout or (n >= 5 and not re.search(quality_rules.ENDS, x)) or (n < 8 and java(quality_rules.NAVIGATION).search(x.lower())) or java(quality_rules.BOILERPLATE).search(x.lower())))
        full = [x for x in lines if SPACED.search(x)]
        lost = sum(len(SPACED.findall(x)) for x, b in zip(lines, bad, strict=True) if b)
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), repeat, sum(bad), lost, failed, not failed and lost <= len(w) / 2, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_bad_lines, r.n_lost_words, r.base_failed, r.kept, r.clean_text) == want, (i, t)
    assert quality_rules.keep_good(frame).columns == frame.columns


def test_token_files(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    crc = collections.Counter((r[0], len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for r, x in zip(rows, ids, strict=True))
    got = token_files.through_files(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crc
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)] == [r[0] or -1 for r in rows]


def test_mixing(docs):
    got = mixing.mix(docs, block=4).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    sources = collections.defaultdict(set)
    for i, _, s in corpus():
        sources[i].add(s)
    assert len(got) == len(corpus()) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for r in got:
        key = next(iter(sources[r.doc_id]))
        by[key][0] += r["size"]
        by[key][1] += r.taken
        by[key][2] = r.target
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6
    assert all(abs(v[1] - v[2]) <= 8 for v in by.values())
    assert bag(mixing.mix(docs.repartition(3), block=4)) == collections.Counter(tuple(r) for r in got)
    assert mixing.apply_mix(docs).columns == docs.columns


def test_mixing_brute_force(docs):
    """Targets by filling up, seats one after the other, blocks laid along each line: all by plain loops."""
    block, per_shard, weights, most = 4, 40, (3, 1, 2), 2
    rows = [(i, len(SPACED.findall(t or "")), s) for i, t, s in corpus()]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, x in rows if x == s) for s in names}
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if most * total[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
            free.remove(s)

    def seats(votes, n):
        won = dict.fromkeys(votes, 0)
        for _ in range(n if any(votes.values()) else 0):
            won[max(votes, key=lambda v: (votes[v] / (2 * won[v] + 1), -list(votes).index(v)))] += 1
        return won

    of_source = seats({s: target[s] for s in names}, int(sum(target.values()) / block + 0.5))
    draw = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    shards = -(-len(rows) // per_shard)
    want = collections.Counter()
    for s in names:
        lines = {k: [] for k in range(shards)}
        for i, n, x in rows:
            if x == s:
                d = draw(0, "" if i is None else i)
                lines[int(d[:8], 16) % shards].append((d, i is not None, i or 0, n))
        lines = {k: sorted(v) for k, v in lines.items() if v}
        quota = seats({k: sum(x[3] for x in v) for k, v in lines.items()}, of_source[s])
        for k, v in lines.items():
            line = sum(x[3] for x in v)
            cover = min(quota[k] * block, line * most)
            rounds, rest = divmod(cover, line) if line else (0, 0)
            start = int(draw(0, k, s or "")[:8], 16) % max(1, -(-line // block)) * block
            at = 0
            for _, known, i, n in v:
                words = range(at, at + n)
                extra = sum(start <= p < start + rest or p < start + rest - line for p in words)
                want[(i if known else None, n, total[s], round(target[s], 6), rounds * n + extra)] += 1
                at += n
    got = mixing.mix(docs, block=block, per_shard=per_shard).withColumn("target", F.round("target", 6))
    assert bag(got) == want


def test_apportion(spark):
    votes = [("a", 53000), ("b", 24000), ("c", 23000), ("d", 0), ("e", 17)]
    for seats in (0, 1, 3, 7, 101):
        won = collections.Counter()
        for _ in range(seats):
            won[max(votes, key=lambda v: (v[1] / (2 * won[v[0]] + 1), -ord(v[0])))[0]] += 1
        df = spark.createDataFrame([(n, v, seats) for n, v in votes], "n string, v long, t long")
        assert {r.n: r.s for r in mixing.apportion(df, ["t"], "v", "t", ["n"], "s").collect()} == {n: won[n] for n, _ in votes}


def test_warc(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://www.a.org/x?q=1", big), (2, "http://a.org/y", big), (9, None, big), (3, "http://b.org/", "small"), (4, "http://b.org/", "small"), (5, "b a d", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = warc.new_path(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, root), root, block=2)
    got = {r.page_id: r for r in warc.read_archives(directory, root).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "revisit", 9: "response", 3: "response", 4: "response", 5: "response"}
    assert got[1].refers_to == 9 and got[3].refers_to is None
    for i, _, h in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    held = sorted((r.asDict() for r in directory.collect()), key=lambda b: b["first"])
    reader = warc.Reader(root)
    assert sorted(r["page_id"] for r in reader.lookup(held, "http://b.org/")) == [3, 4]
    assert [r["page_id"] for r in reader.lookup(held, "http://a.org/x?q=1")] == [1]
    assert reader.lookup(held, "http://nowhere.org/") == []


def test_warc_ties(spark):
    """Equal and null page ids, repeated rows, long payloads, clashing columns, a payload that most pages share."""
    long = "x" * 300_000
    rows = [(1, "http://a.org/1", long, "k"), (1, "http://a.org/1", long, "k"), (None, "http://a.org/2", long, "k"), (3, "http://a.org/3", long[:-1], "k")] + [(10 + i, f"http://e.org/{i}", "<p>error</p>" * 100, "k") for i in range(30)]
    got = warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"))
    seen = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got.collect())
    want = collections.Counter({(1, 300_000, "response", None): 2, (None, 300_000, "revisit", 1): 1, (3, 299_999, "response", None): 1})
    want.update((10 + i, 1200, "revisit" if i < 29 else "response", 39 if i < 29 else None) for i in range(30))
    assert seen == want


def test_html(spark):
    article = "<article><h1>Title</h1><p>A <b>bold</b>&amp; word.<p>Second&nbsp; one</p><div class='comments'><p>first!</p></div></article>"
    page = "<html><body><nav><ul><li><a>Home</a></li><li>Two</li></ul></nav><script>var x='<p>no</p>'</script>{}<footer>&copy; me</footer></body></html>"
    plain = "<html><body><div class='menu'>m</div><div><p>Site name</p><p>{}</p></div></body></html>"
    rows = [(1, "http://h.org/1", page.format(article)), (2, None, None), (3, "http://[bad", ""), *((10 + i, f"http://p.org/{i}", plain.format(f"text {i}")) for i in range(4))]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title A bold& word. Second one", 2: "", 3: "", **{10 + i: f"text {i}" for i in range(4)}}


def test_html_mixed_layouts(spark):
    rows = [(1, "http://m.org/a", "<article>framed text</article>"), (2, "http://m.org/b", "<nav>menu</nav><div>plain <svg/>text</div>"), (3, None, "<main>own</main>"), (4, "http://[", "<div>no host</div>"), (5, "http://c.org/", "<div>a <select-box>b</select-box><svg width='1/>' /> c<nav-bar> d</nav-bar><svg><title>x</title></svg> e</div>")]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "framed text", 2: "plain text", 3: "own", 4: "no host", 5: "a b c d e"}


def test_html_wrapper_groups():
    import time

    of = lambda page: html_wrappers.fold(html_wrappers._nodes(html_wrappers.tokens(page)))
    plain = html_wrappers._placeless
    nodes = of("<ul><li>a</li><li>b</li><li>c</li></ul><p>x")
    assert ["+", ["<li", ["#<ul", None, [0, 1, 2]], "</li"]] in nodes
    both = html_wrappers.align(plain(nodes), plain(of("<ul><li>a</li></ul><hr><p>y")))
    assert ["?", ["<hr"]] in both and ["#", None, []] in both
    # groups of more than eight nodes; long pages that don't fold
    row = "".join(f"<{t}>x</{t}>" for t in ("td", "th", "dd", "dt", "p"))
    assert any(n[0] == "+" and len(n[1]) == 17 for n in of(f"<table>{f'<tr>{row}</tr>' * 3}</table>"))
    r = random.Random(2)
    some = lambda: plain(html_wrappers._nodes(html_wrappers.tokens("".join(f"<{r.choice(['p', 'h2', 'li', 'td', 'pre'])} class=c{r.randrange(400)}>t" for _ in range(10_000)))))
    start = time.time()
    merged = html_wrappers.align(html_wrappers.fold(some()), html_wrappers.fold(some()))
    assert sum(1 for _ in html_wrappers.flat(merged)) > 10_000 and time.time() - start < 60


def test_html_held_out(spark):
    """Generated sites with varying numbers of blocks, framed or not, chrome told by class or by being the same everywhere: the texts that were put in come out."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for site in range(6):
        framed = site % 2 == 0
        banner, imprint = f"Site {site} name", f"All about site {site}"
        for n in range(20):
            texts = [" ".join(word() for _ in range(8)) for _ in range(r.randrange(1, 9))]
            body = "".join(f"<p>{t}</p>" + ("<ul><li>" + "</li><li>".join(texts[i : i + 2]) + "</li></ul>" if r.random() < 0 else "") for i, t in enumerate(texts))
            links = "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(r.randrange(1, 5)))
            menu = f"<ul class='menu'>{links}</ul>"
            comments = "".join(f"<div class='comment'><p>{word()}</p></div>" for _ in range(r.randrange(3)))
            page = f"<html><body><h1>{banner}</h1>{menu}{'<article>' if framed else '<div>'}{body}{comments}{'</article>' if framed else '</div>'}<p>{imprint}</p></body></html>"
            if site == 5 and n == 3:
                page = ""
            rows.append((100 * site + n, f"https://me@my_site{site}.org:80/{n}", page, "k", "h"))
            want[100 * site + n] = " ".join(texts) if page else ""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `a.key` string, host string").repartition(4)
    got = html_wrappers.extract(pages)
    assert got.columns == ["page_id", "url", "a.key", "host", "text", "n_chars"]
    got = {x.page_id: x.text for x in got.collect()}
    right = sum(got[i] == want[i] for i in want)
    assert right >= 0.95 * len(want), (right, next((got[i], want[i]) for i in want if got[i] != want[i]))


def test_line_dedup(spark):
    a = [f"line number {i} of the first text" for i in range(6)]
    b = [a[4], *[f"own line {i} of the second text" for i in range(3)], a[1], a[2], "end of it all at last"]
    rows = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(a)), (3, "\n".join(a)), (4, None), (None, a[0]), (5, "")]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 6, 0), (2, 7, 2), (3, 6, 6), (3, 6, 6), (4, 0, 0), (None, 1, 1), (5, 0, 0)])
    assert line_dedup.patience(list("abcde"), list("xbcye")) == [(1, 1), (2, 2), (4, 4)]


def test_line_dedup_meets_all_holders(spark):
    """Blocks that the first holder has in another order; equal documents of short lines; clashing names; blank lines."""
    p, q = "the line that is called P here", "the line that is called Q here"
    rows = [(1, f"{p}\n{q}", 1, "a"), (2, f"own first line of the second one\n{q}\n{p}", 2, "a"), (3, f"own first line of the third one\n\n{q}\n{p}", 3, "a")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, h long, `first doc` string")).collect()}
    assert got[3].n_removed == 2 and got[3].kept_text == "own first line of the third one\n" and got[3].h == 3


def test_line_dedup_short_lines(spark):
    verse = [f"one two{i} three" for i in range(15)]
    rows = [(1, "\n".join(verse)), (2, "\n".join(["own words here", *verse, "other words there"])), (3, "\n".join(verse)), (4, "own words here\nlast one")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (15, 0), 2: (17, 15), 3: (15, 15), 4: (2, 0)}


def test_line_dedup_all_pairs(spark, monkeypatch):
    """Frequent runs in many orders, with short lines and repeats: just what the alignment of all pairs deletes, in two rounds and in three."""
    r = random.Random(8)
    stock = [f"frequent line {i} of six words" for i in range(8)] + ["one two", "three four", "five", "six seven eight"]
    docs = []
    for i in range(70):
        text = r.sample(stock, r.randrange(3, 10)) + ([r.choice(stock)] if i % 3 else [])
        docs.append((i, "\n".join([f"own line {i} that nobody else has", *text] if i % 5 else text)))
    full = {i: t.split("\n") for i, t in docs}
    want = {i: set() for i, _ in docs}
    for i, _ in docs:
        for j in range(i):
            want[i] |= set(line_dedup.common_blocks(full[j], full[i], [len(x.split()) for x in full[i]], 5))
    for more in ((32,), ()):
        monkeypatch.setattr(line_dedup, "MORE", more)
        got = {x.doc_id: x.kept_text for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == {i: "\n".join(x for k, x in enumerate(full[i]) if k not in want[i]) for i, _ in docs}


def test_line_dedup_recall(spark):
    """Against alignment of all pairs; blank lines and documents that share reordered blocks."""
    r = random.Random(5)
    lines = [f"line {i} {'x' * (i % 5)} of a large stock with enough words" for i in range(60)] + [f"short {i}" for i in range(20)] + [""]
    docs = []
    for i in range(80):
        text = [r.choice(lines) if r.random() < 0.4 else f"own line {i} {j} that nobody else has" for j in range(r.randrange(1, 25))]
        if i % 7 == 3:
            cut = r.randrange(len(docs[-1][1].split("\n")) + 1)
            text = docs[-1][1].split("\n")[cut:] + docs[-1][1].split("\n")[:cut]
        docs.append((i, "\n".join(text)))
    full = {i: [x for x in t.split("\n") if x.strip()] for i, t in docs}
    want = {i: set() for i, _ in docs}
    for i, _ in docs:
        for j in range(i):
            want[i] |= set(line_dedup.common_blocks(full[j], full[i], [len(x.split()) for x in full[i]], 5))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone, found = sum(len(w) for w in want.values()), sum(x.n_removed for x in got.values())
    assert all(x.n_removed <= len(want[i]) for i, x in got.items())
    assert 0.9 * gone <= found <= gone
    assert all(x.kept_text.count("\n\n") <= t.count("\n\n") + x.n_removed and x.kept_text.split("\n").count("") >= t.split("\n").count("") for (i, t) in docs if (x := got[i]).n_removed < len(full[i]))
    print(gone, found)


def test_pii(spark):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    rows = [(1, "card 4111 1111 1111 1111, again 4111111111111111."), (2, "call +1 (212) 555-0199 or mail joe.bloggs@x.org"), (3, None), (4, "no 4111111111111112 number 999.1.1.1"), (5, "on 1999-12-31 and 31.12.1999, not 2023-02-30; ip 10.0.0.1"), (6, ""), (7, "GB82 WEST 1234 5698 7654 32 and 123-45-6789")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    text = dict(rows)
    assert [got[i].n_found for i in range(1, 8)] == [2, 2, 0, 0, 3, 0, 2]
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d[\d ]{14,}\d", got[1].safe_text)]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0])
    assert got[3].safe_text is None and got[4].safe_text == text[4] and got[6].safe_text == ""
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or mail [a-z]{3}\.[a-z]{6}@x\.org", got[2].safe_text)
    iso, dotted = re.search(r"(\d{4}-\d\d-\d\d) and (\d\d\.\d\d\.\d{4})", got[5].safe_text).groups()
    assert iso == "-".join(reversed(dotted.split("."))) != "1999-12-31"
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[7].safe_text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_pii_planted(spark):
    """Values of every kind planted in prose: all are found, nothing else changes, the map is one to one, valid and the same in all documents."""
    r = random.Random(8)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    number = lambda s: int("".join(str(int(c, 36)) for c in s))

    def iban():
        body = digits(18)
        return f"DE{98 - number(body + 'DE00') % 97:02d}{body}"

    ssn = lambda: f"{r.choice([x for x in range(1, 900) if x != 666]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"
    kinds = [
        (card, lambda v: luhn(v) and len(v) == 16),
        (iban, lambda v: re.fullmatch(r"DE\d{20}", v) and number(v[4:] + v[:4]) % 97 == 1),
        (ssn, lambda v: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v)),
        (lambda: f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda v: re.fullmatch(r"\d{4}-\d\d-\d\d", v) and __import__("datetime").date.fromisoformat(v)),
        (lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda v: all(int(x) < 256 for x in v.split("."))),
        (lambda: "".join(r.choice("abcXYZ") for _ in range(40)) + "@mail.example.com", lambda v: re.fullmatch(r"[a-zA-Z]{40}@mail\.example\.com", v)),
        (lambda: f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{digits(4)}", lambda v: re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", v)),
    ]
    pool = [(v, k) for k, (make, _) in enumerate(kinds) for v in {make() for _ in range(40)}]
    docs, planted = [], []
    for i in range(300):
        some = r.sample(pool, r.randrange(0, 6))
        parts = ["".join(r.choice(["lorem ", "ipsum, ", "dolor. ", "sit\n", "àé "]) for _ in range(r.randrange(1, 6))) for _ in range(len(some) + 1)]
        docs.append((i, "".join(x for pair in zip(parts, [v for v, _ in some] + [""], strict=True) for x in (pair[0], pair[1], " " if pair[1] else "")), 1))
        planted.append((parts, some))
    new = {}
    for x in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string, __matches int"), "k").collect():
        parts, some = planted[x.doc_id]
        assert x.n_found == len(some) and x["__matches"] == 1
        pattern = "".join(re.escape(a) + ("(.+?) " if b else "") for a, b in zip(parts, [v for v, _ in some] + [""], strict=True))
        for (v, k), p in zip(some, re.fullmatch(pattern, x.safe_text, re.S).groups(), strict=True):
            assert new.setdefault(v, p) == p and kinds[k][1](p), (v, p)
    assert len(set(new.values())) == len(new) and sum(v == p for v, p in new.items()) == 0
    mails = spark.createDataFrame([(1, "Joe.Bloggs@x.org joe.bloggs@x.org " + "a" * 60 + "@x.org")], "doc_id long, text string")
    a, b, long = pii.pseudonymise(mails, "k").first().safe_text.split()
    assert a.lower() == b and a != b and len({long[i : i + 16] for i in range(0, 48, 16)}) == 3
    with pytest.raises(ValueError):
        pii.pseudonymise(mails, "")


def test_pii_next_to_numbers(spark):
    rows = [(1, "4111111111111111,1999-12-31,123-45-6789"), (2, "10.0.0.1/24"), (3, "BE68 5390 0754 7034 BIC GKCCBEBB"), (4, "4111 1111 1111 1111 123"), (5, "1234 4111 1111 1111 1111 10.0.0.1"), (6, "0.4111111111111111 10.0.0.1.5 1.2.2024.5 41111111111111110 é1"), (7, "7,joe@x.org")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[i].n_found for i in range(1, 8)] == [3, 1, 1, 1, 2, 0, 1]
    assert got[6].safe_text == rows[5][1]
    assert re.fullmatch(r"\d{16},\d{4}-\d\d-\d\d,\d{3}-\d\d-\d{4}", got[1].safe_text) and got[2].safe_text.endswith("/24")
    assert re.fullmatch(r"BE\d\d \d{4} \d{4} \d{4} BIC GKCCBEBB", got[3].safe_text) and re.fullmatch(r"(?:\d{4} ){4}123", got[4].safe_text)
    assert all(v not in r.safe_text for r in got.values() for v in ("123-45-6789", "5390 0754 7034", "joe@") if r.doc_id != 6)


def test_date_permutation_is_one_to_one(spark):
    days = spark.range(0, 146097, 37).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    new = days.select(pii._date(F.col("d"), "k").alias("n")).agg(F.countDistinct("n").alias("n"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert new.n == days.count() and str(new.a) >= "1800-01-01" and str(new.b) <= "2199-12-31"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (substring_dedup.remove_repeats(none), jaccard_join.linked_components(none), mixing.mix(none), quality_rules.measure(none), token_files.through_files(none), line_dedup.dedup_lines(none), pii.pseudonymise(none, "k"), html_wrappers.extract(pages), warc.through_archives(pages)):
        assert df.count() == 0
