"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, html_text, jaccard_join, licenses, mixing, pii, quality_ranking, quality_rules, queries, sharding, token_counts
from lodestone.llm.components import connected_components, merged
from lodestone.llm.jaccard_join import first_of_groups, jaccard_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, size string"
PROSE = " ".join(f"word{i}" for i in range(60))


def frame(spark, rows):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    near = PROSE.replace("word30 ", "other ")
    family = [(100 + i, " ".join(f"w{j}" if j != 3 * i % 90 else f"v{i}" for j in range(90)), "c") for i in range(24)]
    rows = [(0, None, "a"), (1, "", "a"), (2, PROSE, "a"), (3, PROSE.upper(), "b"), (4, near, None), (5, "one two", "b"), (6, "One  TWO", "b"), (6, "One  TWO", "b"), (7, "x" * 200_000, "a"), (8, "  \n\t ", "b"), (9, " ".join(["again"] * 50), "a")]
    return frame(spark, rows + family)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = jaccard_components(docs).collect()
    assert len(found) == len(rows)
    wanted = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    stay = first_of_groups(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, (_, c) in wanted.items() if c == i)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert first_of_groups(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, monkeypatch):
    other = " ".join(f"other{i}" for i in range(60))
    third = " ".join(f"third{i}" for i in range(60))
    near = lambda text, k: text.replace(f"{k} ", "changed ", 1)
    rows = [(5, PROSE, "a"), (5, other, "a"), (5, other, "a"), (3, near(other, "other30"), "a"), (None, third, "a"), (None, near(third, "third30"), "a"), (None, near(PROSE, "word9"), "a"), (8, None, "a"), (8, "", "a")]
    wanted = Counter([(5, PROSE), (3, near(other, "other30")), (None, None), (8, None), (8, "")])
    own = frame(spark, rows).withColumns({"component_id": F.lit("x"), "first_class": F.lit(1), "n": F.lit(2)})
    for few in (jaccard_join.FEW_IDS, 0):
        monkeypatch.setattr(jaccard_join, "FEW_IDS", few)
        monkeypatch.setattr(jaccard_join, "HOT", 2)
        found = first_of_groups(own)
        assert found.columns == own.columns
        assert Counter((r.doc_id, r.text if r.doc_id is not None else None) for r in found.collect()) == wanted
        linked = Counter((r.doc_id, r.component_id) for r in jaccard_components(own).collect())
        assert linked == Counter({(5, 5): 1, (5, 3): 2, (3, 3): 1, (None, None): 2, (None, 5): 1, (8, 8): 2})


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 8), (2, 1)], "a long, b long")
    wanted = {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert {tuple(r) for r in connected_components(edges).collect()} == wanted
    more = spark.createDataFrame([(4, 9), (20, 21)], "a long, b long")
    assert {tuple(r) for r in merged(connected_components(edges), more).collect()} == {(x, 1) for x in (1, 2, 3, 4, 8, 9)} | {(20, 20), (21, 20)}


def test_components_by_rounds(spark, monkeypatch):
    """Edge tables too large for one task give the same components."""
    rng = random.Random(7)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(i, i + 1) for i in range(5000, 5040)] + [(6000, i) for i in range(6001, 6400)] + [(9000, 9000)]
    edges, more = (spark.createDataFrame(x, "a long, b long") for x in (pairs, [(5000, 6000), (1, 6100)]))
    small = Counter(map(tuple, connected_components(edges).collect())), Counter(map(tuple, merged(connected_components(edges), more).collect()))
    monkeypatch.setattr(components, "ROWS", 8)
    assert (Counter(map(tuple, connected_components(edges).collect())), Counter(map(tuple, merged(connected_components(edges), more).collect()))) == small


def test_quality_rules(docs):
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not found[0].kept and found[0].n_words == 0
    assert found[2].kept and found[2].n_repeat_words == 0 and found[2].word_chars == len(PROSE.replace(" ", ""))
    assert found[9].base_failed and found[9].n_repeat_words == 50
    assert found[7].n_words == 1 and found[7].word_chars == 200_000
    passing = quality_rules.passing(docs)
    assert passing.columns == docs.columns and {r.kept for r in passing.collect()} == {"x"}


def test_line_rules(spark):
    menu = "\n".join([PROSE] + ["Home | News | About | Contact | " * 8] * 3)
    shout = "\n".join(f"BUY!! NOW!! word{i}!! IT!! IS!! GOOD!!" for i in range(20))
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, [(1, menu, "a"), (2, shout, "a"), (3, PROSE + "\nAll rights reserved.", "a")])).collect()}
    assert kept == {1: False, 2: False, 3: True}


def test_clean_text(spark):
    text = f"{PROSE}\nHome | News | About | Contact\n\nAll rights reserved.\nlast line"
    rows = {r.doc_id: r.clean_text for r in quality_rules.quality_rules(frame(spark, [(1, text, "a"), (2, None, "a"), (3, "", "a")])).collect()}
    assert rows == {1: f"{PROSE}\n\nlast line", 2: None, 3: ""}


def test_sharding(docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.with_shards(docs)
    assert whole.count() == len(rows)
    assert {(r.doc_id, r.shard) for r in whole.collect()} == {(r.doc_id, r.shard) for r in rows}


def test_shards_when_scans_are_split_otherwise(spark, tmp_path):
    """The second scan of the rows is planned with smaller splits than the first, as when executors join."""
    path = str(tmp_path / "docs")
    frame(spark, [(i, f"{i} " + PROSE, "a") for i in range(400)]).repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        whole = sharding.with_shards(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = whole.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.doc_id for r in rows) == list(range(400))
    assert {(r.doc_id, r.shard) for r in rows} == {(r.doc_id, r.shard) for r in sharding.shard_documents(docs).collect()}


def mixed_rows():
    return [(i, " ".join(["w"] * (1 + i % 40 + (i % 97 == 0) * 900)), None if i % 10 == 0 else f"s{i % 4}" if i % 100 else "tiny") for i in range(2000)] + [(5000, None, "s1"), (5001, "", "s1"), (None, "a b", "s2"), (None, "a b", "s2")]


def test_mixing(spark):
    rows = mixed_rows()
    found = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.taken <= 3 * r.size for r in found)
    sums = Counter()
    for r in found:
        sums[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= max(6, 0.001 * t) for (_, t), n in sums.items())
    assert abs(sum(t for _, t in sums) - sum(r.size for r in found)) < 1e-6 * sum(r.size for r in found)
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mixing_solves_the_dual(spark):
    """Rates against a plain solution of the same convex problem: nested bisections over all documents."""
    import numpy as np

    cells = spark.createDataFrame([(f"={s}", s, len((t or "").split()), 1) for _, t, s in mixed_rows()], "key string, source string, size long, n long")
    rates, tilt = mixing.balance(cells)
    own = rates.select("size", "source_size", "target", "rate").collect()
    size, source, got = (np.array([getattr(r, c) for r in own], dtype=float) for c in ("size", "source_size", "rate"))
    target = np.array([r.target for r in own])
    total, log = size.sum(), np.log(size + 1)
    mean = (size * log).sum() / total
    z = (log - mean) / np.sqrt((size * log * log).sum() / total - mean * mean)

    def solve(mu):
        out = np.zeros(len(size))
        for s in np.unique(source):
            me = source == s
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                r = np.minimum(3, np.exp(mid + mu * z[me]))
                low, high = (mid, high) if (size[me] * r).sum() < target[me][0] else (low, mid)
            out[me] = np.minimum(3, np.exp(high + mu * z[me]))
        return out

    low, high = -5.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        slope = (size * solve(mid) * z).sum() + 0.01 * total * mid
        low, high = (mid, high) if slope < 0 else (low, mid)
    assert abs(tilt - low) < 1e-6 and abs(tilt) > 1e-4
    assert np.abs(got - solve(low))[size > 0].max() < 1e-5
    assert len({round(r.rate, 9) for r in own if r.source_size == max(source)}) > 5  # one source, many rates


def test_copies_stay_with_their_rows(spark, monkeypatch):
    """One id and size in two sources: each row keeps its own source's number; cells split or whole."""
    rows = [(1, "a b c", "s0"), (1, "x y z", "s1")] + [(10 + i, "u v w", "s1") for i in range(40)] + [(7, None, "s0")]
    for part in (mixing.PART, 4):
        monkeypatch.setattr(mixing, "PART", part)
        monkeypatch.setattr(mixing, "FEW", part)
        docs = frame(spark, rows).withColumns({"copies": F.lit("c"), "rate": F.lit(1), "target": F.lit(2), "taken": F.lit(3)})
        out = mixing.take_copies(docs)
        assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text, r.source, r.kept, r.copies) for r in out.collect())
        assert got[1, "a b c", "s0", "x", "c"] == 3
        by_row = mixing.mix_sources(docs).collect()
        assert sum(got.values()) == sum(r.copies for r in by_row)
        taken = Counter()
        for r in by_row:
            taken[r.source_size, r.target] += r.taken
        assert all(abs(n - t) <= 3 for (_, t), n in taken.items())
    assert mixing.take_copies(frame(spark, [])).count() == mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.take_copies(frame(spark, [(1, None, "a"), (2, "", None)])).count() == 0


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 980), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert found["a"] == 30 and found["b"] == 30 and abs(found["c"] - 940) < 1e-9 and found[None] == 0


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, "before " + item.upper() + " after", "a"), (2, " ".join(f"t{i}" for i in range(12)), "a"), (3, "x " * 900 + "short item", "a"), (4, None, "a"), (5, "t" * 100_000, "a")]
    bench = spark.createDataFrame([("q1", item), ("q2", "Short, item!"), ("q3", None), ("q1", item)], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows), bench).collect()}
    assert (found[1].n_hit, found[1].n_items, found[1].contaminated) == (20, 1, True)
    assert found[1].items_sha256 == hashlib.sha256(b"q1").hexdigest()
    assert found[2].n_hit == 0 and not found[2].contaminated
    assert (found[3].n_hit, found[3].contaminated) == (2, False)
    assert found[4].n_words == 0 and found[5].n_words == 1
    left = decontaminate.decontaminated(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_blocks_of_items_add_up(spark):
    bench = spark.createDataFrame([(str(i), " ".join(f"t{j}" for j in range(i, i + 13))) for i in range(8)], "item_id string, text string")
    assert len(list(decontaminate.item_blocks(bench, "item_id", "text", 60))) > 2
    docs = frame(spark, [(1, " ".join(f"t{j}" for j in range(40)), "a"), (2, "t0 t1", "a"), (None, " ".join(f"t{j}" for j in range(3, 18)), "a")])
    whole, parts = (sorted(map(tuple, decontaminate.contamination(docs, bench, limit=x).collect()), key=repr) for x in (1 << 20, 60))
    assert whole == parts and [r[2] for r in whole] == [20, 0, 15]


def test_phrases_and_proximity_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(40)] + [None, "é é", "A, b; C!"]
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([1, 2, 4, 6])))) for k in range(12)] + [("none", None), ("empty", "--")]
    width = 4
    windows = []
    for name, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        windows += [(name, w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)] if w else []
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.positional_index(docs).checkpoint()
    ids = {(r.chunk, i): d for r in index.collect() for i, d in enumerate(r.doc_id)}
    for slop in (0, 1, 3):
        found = {(ids[r.chunk, r["at"]], r["item"], r.start) for r in decontaminate.benchmark_matches(index, bench, slop, width=width).collect()}
        wanted = {(i, *m) for i, t in enumerate(texts) for m in brute_matches(texts, i, windows, slop)}
        assert found == wanted and len(found) > 50


def brute_matches(texts, i, windows, slop):
    """Matches within text ``i``; which word is rarest, and so stands at its place, is a matter of the whole chunk."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    total = Counter(w for t in split for w in t)
    out = set()
    for item, window in windows:
        if not all(total[w] for w in window):
            continue
        rarest = min(range(len(window)), key=lambda k: (total[window[k]], k))
        for p in (p for p, w in enumerate(split[i]) if w == window[rarest]):
            start = p - rarest
            near = all(k == rarest or any(w == q and abs(j - start - k) <= slop for j, q in enumerate(split[i])) for k, w in enumerate(window))
            if near and (slop or 0 <= start <= len(split[i]) - len(window)):
                out.add((item, max(start, 0)))
    return out


def test_decontaminated_rows_go_by_their_texts(spark):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, item, "a"), (1, PROSE, "a"), (None, item + " more", "a"), (None, PROSE, "a"), (2, None, "a"), (2, "", "a"), (3, item, "b")]
    docs = frame(spark, rows).withColumns({"n_words": F.lit(1), "key": F.lit("k"), "contaminated": F.lit(True)})
    left = decontaminate.decontaminated(docs, spark.createDataFrame([("q", item)], "item_id string, text string"))
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, PROSE), (None, PROSE), (2, None), (2, "")])
    assert decontaminate.decontaminated(frame(spark, []), spark.createDataFrame([], "item_id string, text string")).count() == 0


TEXTS = ["mail a.b@c-d.org_e@f.gh and 1.2.3.4.5.6.7.8 or 300.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "call +1 (555) 123-4567 now, +12", None, "", "é" * 10 + "x@y.zz", "a" * 100_000 + "@", "1" * 50_000]


def test_pii(spark):
    rows = {r.doc_id: r for r in pii.find_spans(frame(spark, [(i, t, "a") for i, t in enumerate(TEXTS)])).collect()}
    spans = {i: [(s.kind, s.start, s.end) for s in r.spans] for i, r in rows.items()}
    assert spans[0] == [("email", 5, 16), ("email", 16, 23), ("ip", 28, 35), ("ip", 36, 43)]
    assert spans[1] == [("card", 5, 24)]
    assert spans[2] == [("phone", 5, 22)]
    assert spans[3] == spans[4] == spans[6] == spans[7] == []
    assert spans[5] == [("email", 10, 16)]
    clash = frame(spark, [(1, "x@y.zz", "a")]).withColumns({c: F.lit(1) for c in ("row", "spans", "line", "entity", "term")})
    assert [s.value for s in pii.find_spans(clash).first().spans] == ["x@y.zz"]
    assert pii.find_spans(frame(spark, [])).count() == pii.sanitise(frame(spark, [])).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in digits[::-1])) % 10 == 0


def brute_base(text):
    """Base spans by the contract's own patterns."""
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda x: re.sub("[^0-9]", "", x)
    valid = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    return [(k, m.start(), m.end()) for k, p in pattern.items() for m in re.finditer(p, text or "") if valid[k](m[0])]


def brute_more(texts):
    """Terms and secrets by plain loops over all lines of all texts."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    where, together, spots, values = defaultdict(set), defaultdict(set), [], defaultdict(set)
    for i, text in enumerate(texts):
        at = 0
        for line in (text or "").split("\n"):
            for t in term.findall(line.lower()):
                where[t].add(line)
            own = sorted((a, b) for _, a, b in brute_base(line))
            for k, (a, b) in enumerate(own):
                low = max(own[k - 1][1] if k else 0, a - pii.NEAR)
                high = min(own[k + 1][0] if k + 1 < len(own) else len(line), b + pii.NEAR)
                for m in term.finditer(line):
                    cut = m.start() < a - pii.NEAR < m.end() and low == a - pii.NEAR or m.start() < b + pii.NEAR < m.end() and high == b + pii.NEAR
                    if not cut and (low <= m.start() and m.end() <= a or b <= m.start() and m.end() <= high):
                        together[m[0].lower(), line[a:b]].add(line)
                        spots.append((i, at + m.start(), at + m.end(), m[0].lower(), line[a:b]))
            at += len(line) + 1
    out = [set() for _ in texts]
    for i, a, b, t, e in spots:
        n = len(together[t, e])
        if n >= pii.MIN_CONTEXTS and n >= pii.DISCLOSURE * len(where[t]) and not any(x < b and a < y for _, x, y in brute_base(texts[i])):
            out[i].add(("term", a, b))
    kept = []
    for i, text in enumerate(texts):
        for m in re.finditer(pii.SECRET, text or ""):
            if re.search("[0-9]", m[2]) and re.search("[A-Za-z]", m[2]):
                values[m[1].lower()].add(m[2])
                kept.append((i, m[1].lower(), m.start(2), m.end(2)))
    for i, name, a, b in kept:
        if len(values[name]) >= pii.MIN_CONTEXTS and not any(x < b and a < y for _, x, y in brute_base(texts[i])):
            out[i].add(("secret", a, b))
    return out


def test_pii_against_brute_force(spark):
    rng = random.Random(11)
    people = [("Zebediah", "zeb@host.org"), ("Ana", "+44 20 7946 0958"), ("Bo", "10.1.2.3")]
    filler = "the of and line report about work today it Ana é ü 12".split()

    def line():
        words = [rng.choice(filler) for _ in range(rng.randrange(1, 25))]
        for name, entity in rng.sample(people, rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [name, entity] if rng.random() < 0.9 else [entity]
        if rng.random() < 0.1:
            words.append(f'token = "{rng.getrandbits(120):030x}"')
        if rng.random() < 0.1:
            words.append("build: 1a2b3c4d5e6f7a8b9c0d1e2f")
        return " ".join(words)

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 8))) for _ in range(60)] + TEXTS
    texts += [texts[0]] * 5
    rows = {r.doc_id: r for r in pii.find_spans(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    more = brute_more(texts)
    kinds = Counter()
    for i, text in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in rows[i].spans]
        assert [s for s in spans if s[0] not in pii.MORE] == brute_base(text), i
        assert {s for s in spans if s[0] in pii.MORE} == more[i], i
        assert [s for s in spans if s[0] in pii.MORE] == sorted(more[i], key=lambda s: (pii.MORE.index(s[0]), s[1]))
        assert all(text[s.start : s.end] == s.value for s in rows[i].spans)
        kinds.update(s[0] for s in spans)
    assert min(kinds[k] for k in ("term", "secret", "email", "phone", "ip")) > 5


def test_pii_of_long_texts_takes_linear_time(spark):
    """32,000 words with a term near an entity on every line or all in one line."""
    words = [f"w{i % 5000}" if i % 40 else f"Zebediah zeb{i % 7}@host.org" for i in range(32_000)]
    began = time.time()
    long = [(0, " ".join(words), "a"), (1, "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)), "a")]
    found = {r.doc_id: Counter(s.kind for s in r.spans) for r in pii.find_spans(frame(spark, long)).collect()}
    assert found[0]["email"] == found[1]["email"] == 800
    assert time.time() - began < 40


def test_revealing_terms(spark):
    rows = [(i, f"line {i} by Zebediah at zeb@host.org today", "a") for i in range(4)] + [(10 + i, f"line {i} today by someone at work {i}", "a") for i in range(20)]
    found = pii.find_spans(frame(spark, rows))
    assert {s.value for r in found.collect() for s in r.spans if s.kind == "term"} == {"Zebediah"}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean == {i: f"line {i} by  at [email] today" for i in range(4)}


def test_sanitise_overlapping_spans(spark):
    """A phone number that holds an address: the first span counts, nothing of either stays."""
    rows = [(0, "call +1.2.3.4.55.66 or x@y.zz.", "a")]
    assert [r.text for r in pii.sanitise(frame(spark, rows)).collect()] == ["call [phone] or [email]."]


def test_revealing_terms_of_copies(spark):
    """Copied documents and lines that many documents repeat leave a term's share as it is."""
    own = [(i, f"line {i} by Zebediah at zeb@host.org today", "a") for i in range(3)]
    other = [(10 + i, f"line {i} today by someone at work {i}", "a") for i in range(20)]
    copies = [(100 + 10 * i + c, text, "a") for i, text, _ in own for c in range(9)]
    notices = [(200 + c, f"other {c}\n" + own[0][1], "a") for c in range(5)]
    found = pii.find_spans(frame(spark, own + other + copies + notices)).collect()
    terms = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in found}
    assert len(found) == len(terms) == 3 + 20 + 27 + 5
    assert all(t == (set() if 10 <= i < 100 else {"Zebediah"}) for i, t in terms.items())


def test_html():
    page = "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use <b>cookies</b></div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>er\n text.<p>Second<br>line.</article><div id=comments><p>Nice read</p></div><footer>&copy;</footer></body></html>"
    weight = html_text.weights([])
    assert html_text.extract(page, weight) == "Title & more First bolder text. Second line."
    assert html_text.extract(None, weight) == html_text.extract("", weight) == html_text.extract("<p></p>", weight) == ""
    assert html_text.extract("just text", weight) == "just text"
    assert html_text.extract("<div" + " " * 50_000, weight) is not None


def test_html_around_and_inside_the_article():
    weight = html_text.weights([])
    body = " ".join(f"word{i}" for i in range(40))
    in_ = lambda before, inside, after="": html_text.extract(f"<body>{before}<article>{inside}</article>{after}</body>", weight)
    assert in_("", f"<p>{body}</p>", "<section id=comments><article class=comment><p>I liked it very much</p></article></section>") == body
    assert in_("", f"<p>{body}</p><section id=comments><article class=comment><p>me too</p></article></section>") == body
    assert in_("<aside><article class=card><p>another story here</p></article></aside>", f"<p>{body}</p>") == body
    assert in_("", f'<div class="article-header"><h1>A</h1></div><div><div><div><div><p>{body}</p></div></div></div></div>') == "A " + body
    assert in_("", f'<section class="social-science"><p>{body}</p></section>') == body
    assert in_("", f"<ul><li>one</li><li><a href=x>two</a></li></ul><p>{body}</p><table><tr><td>3</table>") == f"one two {body} 3"
    assert in_("", f"<header><h1>Head</h1></header><p>{body}</p><form><label>name</label></form><aside>see also</aside><p>end</p>") == f"Head {body} end"
    assert in_("<div class=ad>buy this now<nav><a>home</a>", f"<p>{body}</p>") == body  # neither closes
    assert in_("<header><p>The Daily News</p></header>", f"<p>{body}</p>", "<div role=contentinfo>all of it</div>") == body
    assert html_text.extract("<article></article><nav>home</nav>", weight) == ""


def test_html_scan_finds_the_region():
    """No element or class says where the article is: the run of words decides."""
    weight = html_text.weights([])
    body = " ".join(f"word{i}" for i in range(40))
    links = "<div>" + "".join(f"<div><a href={i}>go there</a></div>" for i in range(12)) + "</div>"
    page = f"<body><div>one two</div>{links}<div><p>{body}</p><p>last</p></div>{links}<div>three</div></body>"
    segments, roots = html_text.parse(page, weight)
    assert not roots and not any(s.outside for s in segments)
    assert html_text.extract(page, weight) == body + " last"
    assert len(" ".join(s.text for s in segments).split()) > 80


def test_html_run_against_brute_force():
    rng = random.Random(5)
    weight = html_text.weights([])
    for _ in range(60):
        page = "".join(rng.choice(["a b c ", "d ", "<p>", "</p>", "<a>", "</a>", "<nav>", "</nav>", "<hr>", "<div>", "</div>"]) for _ in range(rng.randrange(1, 25)))
        segments, _ = html_text.parse(page, weight)
        own = [(weight[f"word {s.context}"] + s.outside if s.outside > -html_text.SURE else min(weight[f"word {s.context}"], 0) + s.outside) * len(s.text.split()) for s in segments]
        cost = [sum(weight[f"tag {t}"] for t in s.tags) for s in segments]
        total = {(i, j): sum(own[i:j]) + sum(cost[i + 1 : j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
        first, last = html_text.best_run(segments, weight)
        best = max(total.values(), default=0)
        assert (total[first, last] if last else 0) == pytest.approx(max(best, 0))


def test_html_learns_class_words(spark):
    """A class that no list names is learned from labelled pages and holds on pages that were not among them."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    page = lambda i, root: f"<body><div class='zork'>{' '.join(f'junk{i}y{j}' for j in range(12))}</div><{root}><p>{body(i)}</p><div class='pull'>{i} said</div></{root}><div id=blurb>{i} more of this</div></body>"
    seen = [(i, f"u{i}", page(i, "article")) for i in range(80)]
    clash = [F.lit(1).alias(c) for c in ("n_chars", "feature", "inside")]
    pages = spark.createDataFrame([*seen, (90, "u", None), (91, None, ""), (91, None, "")], "page_id long, url string, html string").select("*", *clash)
    weight = html_text.learn(pages)
    assert max(weight["mark zork"], weight["mark blurb"]) < -html_text.SURE and weight["mark pull"] > 1
    found = html_text.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r.page_id: r for r in found.collect()}
    assert all(rows[i].text == f"{body(i)} {i} said" and rows[i].n_chars == len(rows[i].text) for i in range(80))
    assert rows[90].text == rows[91].text == "" and found.count() == 83
    more = [(i, f"u{i}", page(i, "div")) for i in range(100, 110)]
    unseen = html_text.main_text(spark.createDataFrame(more * 4, "page_id long, url string, html string"), weight=weight).collect()
    assert len(unseen) == 40 and all(f"junk{r.page_id}y3" not in r.text and body(r.page_id) in r.text for r in unseen)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_token_counts():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -1.5), ("▁▁", -9.0)]
    own = token_counts.Unigram(pieces, byte_fallback=False)
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    for text in ("a", "ab ba", "abab  baab", "aé b", "ééa", " a ", "x" * 3000):
        assert own.count(text)[0] == len(theirs.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text
    assert own.count(None) == own.count("") == (0, 0.0)


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="needs the vocabulary file")
def test_token_counts_of_the_production_vocabulary(spark):
    """Against the tokenizers library's unigram model with byte fallback, and against one pass over whole texts."""
    tokenizers = pytest.importorskip("tokenizers")
    pieces, has_bytes = token_counts.load(token_counts.VOCABULARY)
    own = token_counts.Unigram(pieces, has_bytes)
    named = [("<unk>", 0.0), *pieces] + [(f"<0x{b:02X}>", -1e9) for b in range(256)]
    # The library takes the lowest score of all pieces less 10 for what is unknown; byte pieces must not lower it.
    low = min(s for _, s in pieces)
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, max(s, low)) for p, s in named], 0, True))
    rng = random.Random(4)
    alphabet = "abcdefgh the of in. \n\t  éèüß☃😀中文\u2581"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    texts += [" ".join(rng.choice(["the", "token", "of", "réalité", "zzzqqq", "12.5"]) for _ in range(60)), " ", "\n\n", "x" * 5000]
    plain = lambda t: token_counts.SPACE + t.replace(" ", token_counts.SPACE)
    for text in texts:
        assert own.count(text)[0] == own.best(plain(text))[0] == len(theirs.encode(plain(text), add_special_tokens=False).ids), text
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(1, texts[1], "b"), (None, None, "a"), (9999, "", "a")]).withColumns({"n_tokens": F.lit("x"), "score": F.lit("y")})
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(texts) + 3
    assert all(r.n_tokens == (own.count(texts[r.doc_id])[0] if r.doc_id is not None and r.doc_id < len(texts) else 0) for r in rows)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_licenses():
    assert [x[0] for x in licenses.scan("Some prose.\nReleased under the MIT License.\nMore.")] == ["MIT"]
    name, start, end, apart = licenses.scan("See: licensed under the Apache Licence, Version 2.0")[0]
    assert name == "Apache-2.0" and apart == 1
    assert licenses.scan("A license to kill is no notice.") == licenses.scan(None) == licenses.scan("") == []


def test_licenses_in_long_lines_and_short_ones():
    import textwrap

    mit = licenses.TEMPLATES["MIT"][2]
    for notice in (mit, "Released under the MIT License"):
        long = "cell " * 3000 + notice + " cell" * 3000
        assert [(x[0], x[3]) for x in licenses.scan(long)] == [("MIT", 0)]
        assert long[slice(*licenses.scan(long)[0][1:3])] == notice
    for name, text in (("MIT", mit), ("GPL-3.0", licenses.TEMPLATES["GPL-3.0"][1]), ("Apache-2.0", licenses.TEMPLATES["Apache-2.0"][1]), ("CC-BY-4.0", licenses.TEMPLATES["CC-BY-4.0"][1])):
        for columns in (1, 10, 25, 40, 45, 70):
            lines = "\n".join(textwrap.wrap(text, columns, break_long_words=False, break_on_hyphens=False))
            assert [(x[0], x[3]) for x in licenses.scan(f"Some prose.\n{lines}\nMore of it.")] == [(name, 0)], (name, columns)
    assert [x[0] for x in licenses.scan("-" * 300_000 + " All rights reserved " + "-" * 300_000)] == ["Proprietary"]


def test_every_license_template_finds_itself(spark):
    rows, wanted = [], {}
    for i, (name, text) in enumerate((n, t) for n, x in licenses.TEMPLATES.items() for t in x):
        rows.append((i, f"Some prose of its own.\n{text}\nAnd more prose.", "a"))
        wanted[i] = name
    docs = frame(spark, [*rows, rows[0], (100, None, "a"), (None, "", "a")]).withColumns({"licenses": F.lit("l"), "notices": F.lit(1), "n_notices": F.lit(2)})
    found = licenses.license_notices(docs).collect()
    assert len(found) == len(rows) + 3
    for r in found:
        assert r.licenses == wanted.get(r.doc_id, "") and r.n_notices == (r.doc_id in wanted)
        if r.n_notices:
            assert r.notices.endswith(":0")
    assert licenses.license_notices(docs.limit(0)).count() == 0


def best_stretch(words, template):
    """Fewest differing words of any stretch of the text against the whole template, by trying all stretches."""
    best = len(template)
    for i in range(len(words)):
        row = list(range(len(template) + 1))
        for j in range(i, min(len(words), i + 2 * len(template))):
            last, row = row, [row[0] + 1]
            for k, w in enumerate(template):
                row.append(min(last[k] + (w != words[j]), last[k + 1] + 1, row[k] + 1))
            best = min(best, row[-1])
    return best


def test_licenses_with_changed_words_against_all_stretches():
    """A notice is confirmed only within the limit of differing words, and always if some are changed one for one."""
    rng = random.Random(6)
    for name, text in (("MIT", licenses.TEMPLATES["MIT"][2]), ("Apache-2.0", licenses.TEMPLATES["Apache-2.0"][1]), ("ISC", licenses.TEMPLATES["ISC"][0])):
        words = text.split()
        wanted = licenses.WORD.findall(text.lower())
        for changed in (0, 2, 5, len(words) // 2):
            own = list(words)
            for i in rng.sample(range(3, len(words)), changed):
                own[i] = f"other{i}"
            block = " ".join(own)
            found = [x for x in licenses.scan(f"prose before it. {block} prose after it.") if x[0] == name]
            least = best_stretch(licenses.WORD.findall(block.lower()), wanted)
            assert all(x[3] <= licenses.MOST_DIFFERENT * len(wanted) and x[3] >= least for x in found)
            assert bool(found) == (least <= licenses.MOST_DIFFERENT * len(wanted)), (name, changed)


def test_licenses_side_by_side():
    names = lambda text: [x[0] for x in licenses.scan(text)]
    assert names("Copyright 2020 Acme. All rights reserved. Released under the MIT License.") == ["Proprietary", "MIT"]
    assert names("Licensed under the MIT License and licensed under CC BY 4.0, all rights reserved") == ["MIT", "CC-BY-4.0", "Proprietary"]
    assert names("Released under the MIT License. " * 3) == ["MIT"] * 3
    text = "Licensed under CC BY-SA 4.0. " + licenses.TEMPLATES["MIT"][2] + ". " + licenses.TEMPLATES["Apache-2.0"][1]
    found = licenses.scan(text)
    assert [(x[0], x[3]) for x in found] == [("CC-BY-SA-4.0", 0), ("MIT", 0), ("Apache-2.0", 0)]
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_quality_ranking(spark):
    good = [(i, f"This is text number {i}. It says something of its own, {i * 7} times.", "a") for i in range(200)]
    bad = [(1000 + i, f"BUY!! {i}$$$ NOW!! ### | | |", "a") for i in range(200)]
    documents = frame(spark, [*good, *bad, (5000, None, "a"), (5001, "", "a"), (None, "x", "a"), (4, good[4][1], "a")]).withColumns({"score": F.lit("s"), "held_out": F.lit(1), "predicted": F.lit(2), "x": F.lit(3), "label": F.lit(4)})
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + bad] + [(3, 0), (None, 1)], "doc_id long, quality int")
    rows = quality_ranking.score_quality(documents, labels).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id < 1000) for r in rows if r.held_out and r.doc_id < 5000)
    assert len({r.score for r in rows if r.doc_id in (5000, 5001)}) == 1
    assert quality_ranking.score_quality(documents, labels.limit(0)).count() == 404
    assert quality_ranking.score_quality(documents.limit(0), labels).count() == 0


def auc(scores, labels):
    above = [(s > t) + 0.5 * (s == t) for s, a in zip(scores, labels, strict=True) if a for t, b in zip(scores, labels, strict=True) if not b]
    return sum(above) / len(above)


def test_quality_of_texts_that_differ_in_their_words_alone(spark):
    """Junk with the lengths, marks and capitals of good texts; scores of rows that were held out."""
    rng = random.Random(8)
    syllables = ["ba", "ne", "tor", "li", "mu", "san", "der", "o", "pe", "ki"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(len(w))) for w in words]
    text = lambda pool: ". ".join(" ".join(rng.choice(pool) for _ in range(8)).capitalize() for _ in range(6)) + "."
    rows = [(i, text(words if i % 2 else [rng.choice([a, b]) for a, b in zip(words, junk, strict=True)]), "a") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    found = [r for r in quality_ranking.score_quality(frame(spark, rows), labels).collect() if r.held_out]
    assert len(found) > 80
    assert auc([r.score for r in found], [r.doc_id % 2 for r in found]) > 0.97


def test_pairwise_fit_against_gradient_descent():
    """Newton's weights against plain descent on the same pairwise loss."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality_ranking.WIDE))
    x[:, 5:] = 0
    label = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int)
    model = quality_ranking.fit(x, label)
    z = model.expand(x)
    left, right = quality_ranking.pairs(label, 2)
    apart = z[left] - z[right]
    loss = lambda w: np.logaddexp(0, -apart @ w).mean() + quality_ranking.RIDGE / 2 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(apart @ w))
        w -= 0.5 * (-apart.T @ p / len(apart) + quality_ranking.RIDGE * w)
    assert loss(model.weight) <= loss(w) + 1e-9


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    clean = [(200 + i, " ".join(f"p{i}q{j}" for j in range(40)), f"s{i % 3}") for i in range(30)]
    item = " ".join(f"p3q{j}" for j in range(5, 25))
    own = frame(docs.sparkSession, clean).union(docs).select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(f"{path}/documents.parquet")
    docs.sparkSession.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    now, kept = docs.sparkSession.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        out.write.parquet(f"{path}/out/{name}")
        now = spark.read.parquet(f"{path}/out/{name}")
        kept[name] = Counter(r.doc_id for r in now.collect())
        if name != "sharding":
            assert now.columns == own.columns
    first = kept["quality_rules"]
    assert set(range(200, 230)) <= set(first) and not {0, 1, 5, 9} & set(first)
    texts = {r.doc_id: r.text for r in own.collect()}
    groups = brute_components([(i, texts[i]) for i in first])
    assert kept["jaccard_join"] == Counter(i for i, (_, c) in groups.items() if c == i)
    assert set(kept["jaccard_join"]) - set(kept["decontamination"]) == {203}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 3
    assert kept["sharding"] == kept["mixing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = [x[0] for x in found.description]
    ours = queries.queries()[name](spark, SF).select(names).collect()
    assert Counter(map(tuple, ours)) == Counter(found.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
