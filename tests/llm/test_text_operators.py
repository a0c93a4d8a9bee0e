"""Line dedup, quality rules, license scan, mixing, URL filter, packing: against plain Python, with odd rows."""

import zlib
from collections import Counter

import pytest

from ohmgraph.llm import license_scan, line_dedup, mixing, packing, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, size int, _h1 int"
BLANKS = " \t\n\x0b\f\r"


def docs(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", 0, -1, "x", -1, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n ", "a", "Ab c\n\nAB C \n", "x\n" * 50, "é É İ z", "a b c " * 4000]


def test_line_dedup(spark):
    texts = ODD + [f"Common Line\nown {i}\n common line\t" for i in range(10)] + ["nine"] * 9
    out = {r._row.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANKS))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= 10)]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    again = line_dedup.without_common_lines(docs(spark, texts))
    assert again.columns == docs(spark, texts).columns and again.count() == len(texts)


def test_line_dedup_repeated_and_null_ids(spark):
    out = line_dedup.dedup_lines(docs(spark, ["same\nown"] * 12, ids=[None] * 6 + [7] * 6)).collect()
    assert len(out) == 12 and all(r.n_dropped == 2 and r.kept == "" for r in out)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_quality_rules(spark):
    import re

    texts = ODD + ["one two three one two three one two three", "# $ word\nword\nword", " ".join(f"w{i}" for i in range(60)), "A B " * 30]
    led = quality_rules.judged(quality_rules.ledger(docs(spark, texts))).collect()
    by = {r.doc_id: r for r in led}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)), t[:30]
        assert (by[i].n_dup_lines, by[i].n_repeat_words) == (len(lines) - len(set(lines)), len(cover)), t[:30]
        base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert by[i].base_failed == base and (not base or not by[i].kept)
    assert by[len(ODD) + 2].kept
    bits = list(quality_rules.rules())
    for policy, names in quality_rules.POLICIES.items():
        counts = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(quality_rules.ledger(docs(spark, texts)), policy).collect()}
        masks = [{n for n in names if r.failed >> bits.index(n) & 1} for r in led]
        assert counts == {n: (sum(n in m for m in masks), sum(m == {n} for m in masks)) for n in names}
    assert quality_rules.ledger(docs(spark, [])).count() == 0


def scanned_by_hand(text):
    """The base places, labels, score and places of a text."""
    scan, words, found, best = license_scan, license_scan.template_words(text or ""), [], 0.0
    k, near = scan.K, scan.NEAR
    base = [(j, v) for p, v in scan.BASE.items() for q in [p.split()] for j in range(len(words)) if words[j : j + len(q)] == q]
    for t, (label, notice, more) in enumerate(scan.NOTICES):
        own = scan.template_words(notice)
        hits = sorted((i - j, i, j) for i in range(len(words) - k + 1) for j in range(len(own) - k + 1) if words[i : i + k] == own[j : j + k])
        groups = []
        for d, i, j in hits:
            if not groups or d - groups[-1][-1][0] > near:
                groups.append([])
            groups[-1].append((d, i, j))
        for g in groups:
            start, end = min(i for _, i, _ in g), max(i for _, i, _ in g) + k
            covered = {j + x for _, _, j in g for x in range(k)}
            around = {p for _, i, _ in g for p in range(max(0, i - near), min(len(words), i + k + near)) if start <= p < end}
            must = {j for j, w in enumerate(own) if w in scan.TELLING or w in more.split()}
            if must <= covered and not any(words[p] in scan.TELLING and words[p] not in own for p in around):
                share = len(covered) / max(len(own), end - start)
                best = max(best, share)
                if share >= scan.COVERED:
                    found.append((start, end, t, label, share, len(covered)))
    kept, runs = [], []
    for f in sorted(found):
        if not runs or f[0] >= max(x[1] for x in runs[-1]):
            runs.append([])
        runs[-1].append(f)
    for run in runs:
        top = max(run, key=lambda f: (f[4], f[5], -f[2]))
        kept += [f for f in run if f[3] == top[3] or f[0] >= top[1] or f[1] <= top[0]]
    labels = {v for _, v in base} | {f[3] for f in kept}
    phrase = {v: len(p.split()) for p, v in scan.BASE.items()}
    places = sorted([(j, j + phrase[v], v, 1.0) for j, v in base] + [(f[0], f[1], f[3], f[4]) for f in kept])
    return len(words), base, ",".join(sorted(labels)), 1.0 if base else best, places


LICENSED = {
    "Under the MIT License, under the mit license": "mit",
    "cc-by-nc cc by nc 4.0": "cc-by-nc",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "This is licensed under the GNU General Public License, v3": "gpl",
    "is licensed under the GNU Public General License": "",
    "under the terms of the GNU General Public License as published": "gpl",
    "You can use it under the terms of the GNU Lesser General Public License": "lgpl",
    "licensed under the GNU Lesser General Public License": "lgpl",
    "under the terms of the GNU Affero General Public License": "agpl",
    "licensed under the terms of the GNU Library General Public License": "",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "All rights reserved.": "proprietary",
    "SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2",
    "SPDX-License-Identifier: WTFPL": "",
    "Licensed under the GNU General Public License. Or licensed under the GNU Lesser General Public License.": "gpl,lgpl",
    "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files": "mit",
    "mit": "",
}


def test_license_scan(spark):
    texts = ODD + list(LICENSED)
    out = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, base, labels, score, places = scanned_by_hand(t)
        r, starts = out[i], [j for j, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({v for _, v in base})) and r.labels == labels and r.score == pytest.approx(score), t
        assert [(p.start, p.end, p.label, p.covered) for p in r.places] == [(*p[:3], pytest.approx(p[3])) for p in places], t
        if t in LICENSED:
            assert r.labels == LICENSED[t], t
    assert license_scan.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.templates(spark, {"two words": "x"}, ())


def test_license_scan_of_edited_notices(spark):
    import random

    rng, texts = random.Random(3), []
    pool = ["lesser", "the", "gnu", "affero", "x", "license", "noncommercial", "of", "under"]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = license_scan.template_words(rng.choice(license_scan.NOTICES)[1])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(pool)], [rng.choice(pool)] * 2])
            words += own + [rng.choice(pool)] * rng.randint(0, 3)
        texts.append(" ".join(words))
    out = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        _, _, labels, score, places = scanned_by_hand(t)
        assert (out[i].labels, out[i].score) == (labels, pytest.approx(score)), t
        assert [(p.start, p.end, p.label) for p in out[i].places] == [p[:3] for p in places], t


def test_license_scan_of_repeated_rows(spark):
    texts = ["under the mit license"] * 3 + [None] * 2 + ["all rights reserved"]
    out = license_scan.scan(docs(spark, texts, ids=[1, 1, None, 2, 2, None])).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.labels, len(r.places)) for r in out) == [(0, 0, "proprietary", 1), (0, 1, "mit", 1), (1, 1, "mit", 1), (1, 1, "mit", 1), (2, 0, "", 0), (2, 0, "", 0)]


def test_mixing(spark):
    texts = ["w " * (i % 7 * 40) for i in range(60)] + [None, "one"]
    sources = [["a", "b", "c", None][i % 4] for i in range(60)] + ["b", "tiny"]
    out = mixing.mix(docs(spark, texts, sources), block=16).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    goal = mixing.targets(dict(sizes))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == int(goal[s] + 0.5) and all(r.taken <= 2 * r["size"] for r in own)
    assert len(out) == len(texts)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs(spark, texts, sources), block=64).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}  # the block size moves no words
    used = mixing.mixed_documents(docs(spark, texts, sources)).collect()
    assert sum(len(r.text.split()) for r in used) == sum(r.taken for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [None, ""])).count() == 0


def test_mixing_keeps_repeated_rows(spark):
    texts, ids = ["a b", "a b", None, None, "", ""], [1, 1, 2, 2, None, None]
    out = mixing.mix(docs(spark, texts, ids=ids)).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in out) == [(0, 0), (0, 0), (1, 2), (1, 2), (2, 0), (2, 0)]
    assert sum(r.taken for r in out) == 6 and all((r.first_slot is None) == (r.taken == 0) for r in out)
    used = mixing.mixed_documents(docs(spark, texts, ids=ids)).collect()
    assert sorted(r.text for r in used) == ["a b"] * 3


def test_mixing_follows_its_schedule(spark):
    import hashlib
    import itertools
    import math

    texts = [" ".join(f"d{i}w{j}" for j in range(i * 37 % 90)) for i in range(200)]
    sources = [["a", "b", "b", "b", None][i % 5] for i in range(200)]
    block = 32
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    names, goal = ["a", "b", None], mixing.targets(dict(sizes))
    total = sum(goal.values())
    ends = list(itertools.accumulate(goal[s] / total for s in names))
    slots = math.ceil(total / block)
    at = [sum(e <= i * mixing.GOLDEN % 1.0 for e in ends[:-1]) for i in range(slots)] + [i % 3 for i in range(mixing.SPARE * 3)]
    want, rank = {}, Counter()
    stream = {s: [w for i in sorted((i for i in range(200) if sources[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for w in texts[i].split()] for s in names}
    given = Counter()
    for slot, k in enumerate(at):
        s = names[k]
        blocks = math.ceil(sizes[s] / block)
        turn, b = divmod(rank[s], blocks)
        rank[s] += 1
        for w in stream[s][b * block : (b + 1) * block]:
            if given[s] < int(goal[s] + 0.5):
                given[s] += 1
                i = int(w[1 : w.index("w")])
                n, first = want.get((i, turn), (0, slot))
                want[i, turn] = (n + 1, first)
    out = mixing.mix(docs(spark, texts, sources), block=block).collect()
    got = {(r.doc_id, k): (u.n, u.slot) for r in out for k, u in enumerate(r.uses)}
    assert got == want
    assert all(r.first_slot == (want[r.doc_id, 0][1] if (r.doc_id, 0) in want else None) for r in out)
    # every partition of the mix is in its order
    order = mixing.mixed_documents(docs(spark, texts, sources), block=block)
    for part in order.select("doc_id").rdd.glom().collect():
        left, last = {i: [u.slot for k, u in sorted((k, u) for (j, k), u in ((kv, mixing_use(v)) for kv, v in want.items()) if j == i)] for i in {r.doc_id for r in part}}, -1
        for r in part:
            slot = left[r.doc_id].pop(0)
            assert slot >= last
            last = slot


def mixing_use(pair):
    from pyspark.sql import Row

    return Row(n=pair[0], slot=pair[1])


def test_schedule_gives_every_stretch_the_shares(spark):
    goal = {f"s{i}": float(10 + i % 7) for i in range(40)} | {None: 500.0, "none": 0.0}
    rows = [r.source for r in mixing.schedule(spark, goal, block=1).orderBy("slot").collect()]
    assert len(rows) == int(sum(goal.values()) + 0.5) + mixing.SPARE * 41 and "none" not in rows
    half = Counter(rows[: len(rows) // 4])
    assert half[None] == pytest.approx(len(rows) // 4 * 500 / sum(goal.values()), abs=8)


def test_targets_stop_at_the_limit():
    got = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert got == {"a": 20.0, "b": pytest.approx(2995 / 3), None: pytest.approx(2995 * 2 / 3)}


URLS = [None, "", "x", "https://A.ORG/x", "http://b.example.org/es/1?q", "http://example.org/en/1x", "http://org?/", "http://s.com/fr/a#b", "http://com/de/", "http://notorg.net/", "http://myorg/", "://org/é"]


def test_url_filter(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    rows = [(i, u, "h", "h") for i, u in enumerate(URLS)]
    out = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), rules).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(r), r, v) for r, v in rules for h, p in [url_filter.split_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, best and best[1], best[2] if best else "allow"), u
    none = url_filter.judge_urls(spark.createDataFrame(rows[:2], "page_id long, url string, a string, b string"), [])
    assert [r.verdict for r in none.collect()] == ["allow"] * 2


def test_url_index_survives_colliding_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    (tmp_path / "i").write_bytes(url_filter.index_bytes([(f"h{i}.org/", "block") for i in range(9)] + [("org/a", "allow")]))
    index = url_filter.Index(str(tmp_path / "i"))
    assert index.best(["h3.org", "zz.org", "a.h8.org"], ["/b", "/ab", "/"]) == (["h3.org/", "org/a", "h8.org/"], ["block", "allow", "block"])


def test_packing(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD + ["It's <|endoftext|> we'LL. ΑΣ, É́x 1,2. ,. a\x1cb"] + [f"word{i} thing" * (i % 90) for i in range(120)]
    rows = packing.pack(docs(spark, texts), path, batch=4000).collect()
    tok = Tokenizer.from_file(path)
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(own) <= packing.SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    import random

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), random.Random(1)
    letters = [*"abcXYZ019 '\"-.,<|>é\u0301É\u00a0İß\u030aK\x1c\x85\n\t\u3000日本ſŸ²½ªº_", "st'll're", "<|endoftext|>", "'s", "'LL"]
    texts = [None, "", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000))]
    ids, tok = packing.Ids(path, most=300), Tokenizer.from_file(path)
    got = [x for k in range(0, len(texts), 100) for x in ids.encode(pa.array(texts[k : k + 100]))]
    assert ids.by_piece == (name == "word_bpe_49k.json")
    assert got == [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_under_three_limits(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    texts = [f"word{i} thing, " * (i % 61) for i in range(150)] + [None, "a b " * 3000]
    some = docs(spark, texts).withColumn("answer", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") * 7 % 200))
    for cut in (True, False):
        rows = packing.pack(some, public_tokenizers.path("word_bpe_49k.json"), length=256, segments=3, loss_tokens=100, cut=cut, loss_col="answer").collect()
        pieces, sequences = {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        for i, own in pieces.items():
            n = own[0].doc_tokens
            bearing = min(n, i * 7 % 200) if i % 5 else n
            for r in own:
                assert r.loss == max(0, r.start + r.length - max(r.start, n - bearing)), (i, r)
            assert sum(r.length for r in own) == n and sum(r.loss for r in own) == bearing
        assert set(pieces) == set(range(len(texts)))
        for own in sequences.values():
            assert sum(r.length for r in own) <= 256 and len(own) <= 3 and sum(r.loss for r in own) <= 100
        assert max(len(own) for own in sequences.values()) == 3


def test_placement_prefers_the_direction_of_the_demands():
    # the second example turns to the bin whose room is like its demands, though the other one is fuller
    pieces = [packing.Piece(0, 0, 60, 10), packing.Piece(1, 0, 55, 50), packing.Piece(2, 0, 30, 1)]
    bins = packing.place(pieces, (100, 8, 60))
    assert [[p.example for p in b.pieces] for b in bins] == [[0], [1, 2]]

    def by_hand(pieces, limits):
        rooms, out = [], []
        for p in sorted(pieces, key=lambda p: (-p.length, p.example, p.start)):
            need = [p.length / limits[0], 1 / limits[1], p.loss / limits[2]]
            able = [k for k, room in enumerate(rooms) if room and all(a >= b - 1e-12 for a, b in zip(room, need, strict=True))]
            if able:
                score = lambda k: sum(a * b for a, b in zip(rooms[k], need, strict=True)) / (sum(a * a for a in rooms[k]) ** 0.5 + 1e-9)
                best = min(able, key=lambda k: (-round(score(k), 9), rooms[k][0]))
            else:
                rooms.append([1.0] * 3)
                out.append([])
                best = len(rooms) - 1
            out[best].append(p.example)
            rooms[best] = [a - b for a, b in zip(rooms[best], need, strict=True)]
            if any(a * c < 0.5 for a, c in zip(rooms[best], limits, strict=True)):
                rooms[best] = None
        return out

    import random

    rng = random.Random(5)
    pieces = [packing.Piece(i, 0, n := rng.randint(1, 400), rng.randint(0, n)) for i in range(200)]
    assert [[p.example for p in b.pieces] for b in packing.place(pieces, (512, 6, 300))] == by_hand(pieces, (512, 6, 300))


def test_packing_keeps_all_limits():
    import random

    rng = random.Random(1)
    lengths = [rng.randint(1, 700) for _ in range(300)]
    losses = [rng.randint(0, n) for n in lengths]
    for cut in (False, True):
        bins = packing.pack_batch(lengths, losses, (512, 4, 300), cut)
        assert all(b.used <= 512 and len(b.pieces) <= 4 and sum(p.loss for p in b.pieces) <= 300 for b in bins)
        assert sum(b.used for b in bins) == sum(lengths)
        assert sum(p.loss for b in bins for p in b.pieces) == sum(losses)
