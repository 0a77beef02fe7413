"""Fingerprints, posteriors and template trees against plain loops that share no code with the operators."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash


def spark_hash(*values):
    """Spark's xxhash64: 64-bit XXH64, chained over the values from 42 on; longs are eight bytes, ints four."""
    h = 42
    for kind, v in values:
        data = v.encode() if kind == "s" else (v % (1 << (64 if kind == "l" else 32))).to_bytes(8 if kind == "l" else 4, "little")
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_fingerprint_parts(spark):
    from tamga.llm import imatch

    rng = random.Random(4)
    pool = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(pool, weights=[1 / (i + 1) for i in range(300)], k=rng.choice([1, 3, 8, 30, 90]))) for _ in range(120)]
    texts += [None, "", texts[0], texts[0] + ", " + texts[1], "The, the; THE! rare1 rare2"]
    data = list(enumerate(texts))
    terms = [{w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w} for t in texts]
    held = Counter(w for ws in terms for w in ws)
    n = len(texts)
    low, high = max(1, math.ceil(n * imatch.RAREST)), max(1, math.floor(n * imatch.COMMONEST))
    lexicon = {w for w, c in held.items() if low <= c <= high}

    def parts(ws):
        inside = [spark_hash(("s", w)) for w in ws if w in lexicon]
        every = [spark_hash(("s", w)) for w in ws]
        out = []
        for level in range(imatch.LEVELS):
            for seed in range(imatch.SEEDS):
                seen = sorted(spark_hash(("l", t), ("i", seed)) for t in (inside if len(inside) >= imatch.LEAST + imatch.LEAST_STEP * seed else every))
                subset = [t for t in seen if t & ((1 << (1 + 2 * level)) - 1) == 0]
                out.append(spark_hash(*(("l", t) for t in subset)) & 0x7FFFFFFF | 1 if subset else 0)
        return out if any(out) else [spark_hash(*(("l", t) for t in sorted(every))) & 0x7FFFFFFF | 1] * len(out)

    def likeness(a, b):
        if a == b:
            return 1.0
        best, both, all_held = [], 0, 0
        for level in range(imatch.LEVELS):
            pairs = list(zip(a, b))[level * imatch.SEEDS : (level + 1) * imatch.SEEDS]
            equal, some = sum(x == y != 0 for x, y in pairs), sum(bool(x or y) for x, y in pairs)
            best.append(equal / some if 2 * some >= imatch.SEEDS else 0.0)
            both, all_held = both + equal, all_held + some
        return max(*best, both / all_held if all_held else 0.0)

    got = {r.doc_id: r for r in imatch.edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    shown = lambda p: "".join(f"{x:08x}" for x in p)
    prints = [parts(ws) for ws in terms]
    for i, t in data:
        t, following = t or "", texts[(i + 1) % n] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        own = parts({w for w in re.split(r"[\s!-/:-@\[-`{-~]+", edited.lower()) if w})
        assert got[i].fingerprint == shown(prints[i]) and got[i].edited == edited and got[i].edited_fingerprint == shown(own)
        assert got[i].near_edited == pytest.approx(likeness(prints[i], own)) and got[i].near_next == pytest.approx(likeness(prints[i], prints[(i + 1) % n]))


def test_posterior(spark):
    import numpy as np

    from tamga.llm import langid

    rng = random.Random(5)
    said = {"en": "the house and garden of an old man with dogs", "fr": "la maison et le jardin de cet homme avec un chien", "de": "das haus und der garten von dem alten mann mit hund"}
    rows = []
    for i in range(90):
        one = rng.choice(list(said))
        words = rng.choices(said[one].split() + rng.choice(list(said.values())).split(), k=rng.choice([1, 2, 4, 12]))
        host = rng.choice(["a.uk", "b.uk", "c.fr", "d.de", None])
        rows.append((i, " ".join(words), one, rng.choice([one, one, "en", None]), host and host[-2:], host))
    rows += [(90, None, "en", "en", "uk", "a.uk"), (91, "", None, "xx", None, "new.zz"), (92, "1 2 3 %%", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, declared string, suffix string, host string")
    model = langid.fit_text_model(docs, "lang", "text")
    got = {r.doc_id: r for r in langid.identify(docs, model, "text", "declared", "suffix", "host").collect()}

    def trigrams(text):
        data = b"  " + (text or "").lower().encode()
        out = []
        for a, b, c in zip(data, data[1:], data[2:]) if text else ():
            h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
            out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16)
        return out

    # the tables: distinct texts of each label, copies once
    for k, one in enumerate(model.languages[:-1]):
        counts = Counter(x for t in {r[1] for r in rows if r[2] == one and r[1]} for x in trigrams(t))
        whole = sum(counts.values()) + 0.05 * langid.BINS
        for x in list(counts)[:50] + [0, 77]:
            assert model.tables[k, x] == pytest.approx(math.log((counts[x] + 0.05) / whole))
    n = len(model.languages)
    ll = {i: [langid.TEMPER * sum(model.tables[k, x] for x in trigrams(t)) for k in range(n)] if t else None for i, t, *_ in rows}
    first = {i: int(np.argmax(x)) for i, x in ll.items() if x}
    total = [sum(c == k for c in first.values()) for k in range(n)]
    base = [(x + 1) / (sum(total) + n) for x in total]

    def counts(place, value):
        return [sum(first.get(r[0]) == k for r in rows if r[place] == value) for k in range(n)]

    def smooth(c, above):
        return [(x + langid.WEIGHT * p) / (sum(c) + langid.WEIGHT) for x, p in zip(c, above)]

    known = {place: {r[place] for r in rows if r[0] in first} for place in (3, 4, 5)}
    for i, t, _, declared, suffix, host in rows:
        prior = smooth(counts(5, host), smooth(counts(4, suffix), base)) if host in known[5] else base
        logs = [x + math.log(p) for x, p in zip(ll[i] or [0.0] * n, prior)]
        for place, value in ((3, declared), (4, suffix)):
            if value in known[place]:
                c = counts(place, value)
                logs = [x + math.log((c[k] + 1) / (total[k] + len(known[place]) + 1)) for k, x in enumerate(logs)]
        top = max(logs)
        posterior = 1 / sum(math.exp(x - top) for x in logs)
        assert got[i].language == model.languages[logs.index(top)] and got[i].posterior == pytest.approx(posterior, rel=1e-6)
        assert got[i].accepted == (bool(t) and got[i].language != langid.UNKNOWN and posterior >= langid.ACCEPTED)


def test_template_tree(spark):
    from tamga.llm import urls

    rng = random.Random(6)
    pages = []
    for i in range(700):
        host = rng.choice(["h.x", "h.x", "g.x", "i.x"])
        deep = [rng.choice(["spam", "news", "a", "b", "blog", "", str(rng.randrange(50)), f"{rng.randrange(16**9):09x}1"]) for _ in range(rng.choice([0, 1, 2, 2, 3, 5]))]
        path = "/" + "/".join(deep) if deep else ""
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.9 if "spam" in deep else 0.1))
        pages.append((i, f"http://{host}{path}", host, path, bad))
    df = spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")
    labels = spark.createDataFrame([(p[0], p[4]) for p in pages if p[4] is not None], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge_urls(df, labels, {}).collect()}

    form = lambda s: re.sub(r"\d+", "{n}", re.sub(r"[0-9a-fA-F]*\d[0-9a-fA-F]{7,}", "{id}", s))
    segments = {p[0]: tuple(form(s) for s in re.sub("^/", "", p[3]).split("/")) for p in pages}
    paths = defaultdict(list)
    for i, _, host, _, bad in pages:
        paths[host, segments[i]].append(bad)
    stats = {k: (sum(b is not None for b in v), sum(b or 0 for b in v)) for k, v in paths.items()}
    template, active, level = dict.fromkeys(paths, ""), set(paths), 0
    fit = lambda k, n: k * math.log(k / n) if k > 0 else 0.0
    both = lambda k, n: fit(k, n) + fit(n - k, n)
    while active:
        branches = defaultdict(lambda: defaultdict(list))
        for key in active:
            branches[key[0], template[key]][key[1][level] if level < len(key[1]) else ""].append(key)
        after = set()
        for children in branches.values():
            sums = {c: tuple(sum(stats[k][j] for k in keys) for j in (0, 1)) for c, keys in children.items()}
            n, bad = (sum(s[j] for s in sums.values()) for j in (0, 1))
            bound = urls.SIMILAR**2 + 2 * math.log(max(sum(s[0] > 0 for s in sums.values()) - 1, 1))
            alone = sum(map(len, children.values())) == 1
            for c, keys in children.items():
                a, b = sums[c]
                alike = a == 0 or 2 * (both(b, a) + both(bad - b, n - a) - both(bad, n)) < bound
                step = "" if c == "" else "/*" if len(children) > 1 and alike else f"/{c}"
                for key in keys:
                    template[key] += step + ("".join(f"/{s}" for s in key[1][level + 1 :] if s) if alone else "")
                    if not alone and len(key[1]) > level:
                        after.add(key)
        active, level = after, level + 1
    all_n, all_bad = (sum(s[j] for s in stats.values()) for j in (0, 1))
    share = (all_bad + 0.5) / (all_n + 1)
    of = lambda test: [sum(s[j] for k, s in stats.items() if test(k)) for j in (0, 1)]
    for i, _, host, _, _ in pages:
        key = host, segments[i]
        n, bad = of(lambda k: k[0] == host)
        above = (bad + urls.WEIGHT * share) / (n + urls.WEIGHT)
        n, bad = of(lambda k: k[0] == host and template[k] == template[key])
        purity = (bad + urls.WEIGHT * above) / (n + urls.WEIGHT)
        assert got[i].template == template[key] and got[i].purity == pytest.approx(purity)
        assert got[i].verdict == ("block" if purity > urls.BAD else "allow")
    assert {r.verdict for r in got.values()} == {"block", "allow"}
