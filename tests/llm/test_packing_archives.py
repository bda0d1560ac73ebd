"""Packing, archives and license scans: exact round trips and brute force, with edge cases."""

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from sessionloom.llm import licenses, packing, queries, warczip

DOC = "doc_id long, text string, bucket string, piece string, offset int, license string"
PAGE = "page_id long, url string, html string, digest string, d1 int, path string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "p", 1, "l") for i, t in rows], DOC)


def test_pieces_are_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "sea", "über", "1999", "\n\n", "ŝ", "日本"]) for _ in range(rnd.randint(0, 300)))) for i in range(300)]
    rows += [(None, None), (1000, ""), (1000, ""), (1001, "word " * 9000), (1002, "<|endoftext|> x\xa0y z"), (1003, "a" * 5000)]
    got = packing.pack(frame(spark, rows), queries.tokenizer_file(), tokens=256, bucket_docs=100).collect()
    tok = Tokenizer.from_file(queries.tokenizer_file())
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0] if len(ids) % 256 == 0 else [0, len(ids) % 256]
        cuts += list(range(cuts[-1] + 256, len(ids) + 1, 256))
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(full) <= 1.03 * sum(r["length"] for r in got) / 256 + 4


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(score):
    lengths = np.random.default_rng(1).integers(1, 300, 2000)
    bins, offsets = packing.best_fit(lengths, (1000, 6, 200_000.0), score=score)
    for b in np.unique(bins):
        part = lengths[bins == b]
        assert part.sum() <= 1000 and len(part) <= 6 and (part.astype(float) ** 2).sum() <= 200_000
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == np.concatenate([[0], np.cumsum(part[order])[:-1]]).tolist()
    assert sorted(np.unique(bins)) == list(range(bins.max() + 1))
    assert len(packing.best_fit(np.array([], np.int64), (10, 10, 100))[0]) == 0


def plain_best_fit(lengths, cap, weights, score):
    """Vector best-fit as defined: every piece, longest first, over all open bins."""
    left, bins = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        fits = [k for k, room in enumerate(left) if all(r >= v for r, v in zip(room, need))]
        if score == "dot":
            rate = {k: -sum(w * r * v / c**2 for w, r, v, c in zip(weights, left[k], need, cap)) for k in fits}
        else:
            rate = {k: sum(w * (r - v) ** 2 / c**2 for w, r, v, c in zip(weights, left[k], need, cap)) for k in fits}
        if fits:
            k = min(fits, key=lambda k: rate[k])
        else:
            k = len(left)
            left.append(list(cap))
        left[k] = [r - v for r, v in zip(left[k], need)]
        bins[i] = k
    return bins, left


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("cap,weights", [((1000, 1000, 1e6), (1, 0, 0)), ((1000, 6, 200_000.0), (1, 1, 1)), ((500, 4, 60_000.0), (1, 3, 2)), ((300, 300, 90_000.0), (1, 1, 1))])
def test_best_fit_chooses_the_bins_of_the_plain_form(score, cap, weights):
    lengths = np.random.default_rng(5).integers(1, 240, 400)
    bins, _ = packing.best_fit(lengths, cap, weights, score)
    want, _ = plain_best_fit(lengths.tolist(), cap, weights, score)
    # bins with equal room are interchangeable, and their contents with them: the loads of all bins are compared
    loads = [sorted(np.bincount(b, weights=lengths).astype(int).tolist()) for b in (bins, np.array(want))]
    assert loads[0] == loads[1]


def test_ids_come_back_and_empty_table(spark):
    got = packing.pack(frame(spark, [(1, "hello sea"), (2, "x")]), queries.tokenizer_file(), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert len({r["sequence_id"] for r in got}) == 1
    assert packing.pack(frame(spark, []), queries.tokenizer_file()).count() == 0


def test_encoders_agree_on_latin_texts():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(queries.tokenizer_file()), packing.encoder(queries.tokenizer_file())
    rnd = random.Random(8)
    letters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(161, 256)]]
    for _ in range(400):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert fast(t) == tok.encode(t, add_special_tokens=False).ids


def read_back(spark, pages, **kw):
    packages = warczip.write_packages(pages, **kw)
    return packages, warczip.read_records(warczip.places(packages)).collect()


def test_archive_round_trip(spark):
    big, other = "<p>é" + "x" * 120, "y" * 100
    rows = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (None, "http://n", big), (3, "http://b\r\nX: 1 2", "short"), (4, "", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (10, "u", other), (11, "u", "a\r\n\r\nb" * 50), (12, "u", "z" * 99), (13, "u", "z" * 99),
            (14, "u", "<b>" * 400_000)]
    pages = spark.createDataFrame([(*r, "d", 1, "p") for r in rows], PAGE)
    packages, got = read_back(spark, pages, package_bytes=400)
    assert packages.count() > 3 and all(r["intact"] for r in got)
    first = {big: 2, other: 8}
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        again = h in first and i != first[h]
        want.append((i, "revisit" if again else "response", len(data), hashlib.sha256(data).hexdigest(), first[h] if again else None, None if again else data))
    cut = [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(cut, key=str) == sorted(want, key=str)
    assert {r["page_id"]: r["url"] for r in got}[3] == "http://b%0D%0AX: 1 2"


def test_archive_of_no_pages(spark):
    packages, got = read_back(spark, spark.createDataFrame([], PAGE))
    assert packages.count() == 0 and got == []


def as_file(data):
    return io.BytesIO(data), len(data)


def test_directory_with_zip64_and_comment():
    records = [("k", b"abc"), ("j", b"defg")]
    plain, wide = warczip.package(records), warczip.package(records, zip64=True)
    for data in (plain, wide):
        found = {m.name: m for m in warczip.members(*as_file(data))}
        for name in (warczip.WARC_MEMBER, warczip.INDEX_MEMBER):
            m = found[name]
            assert data[m.offset: m.offset + m.size] == zipfile.ZipFile(io.BytesIO(data)).read(name)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"12345")
        z.comment = b"PK\x05\x06 looks like an end record"
    data = out.getvalue()
    m, = warczip.members(*as_file(data))
    assert data[m.offset: m.offset + m.size] == b"12345"


def test_lines_find_their_own_member():
    parts = {"archive/a.warc.gz": b"A" * 30, "archive/b.warc.gz": b"B" * 20}
    lines = ['k1 20240101 {"filename": "b.warc.gz", "offset": "5", "length": "7"}', 'k2 20240101 {"filename": "archive/a.warc.gz", "offset": 10, "length": 4}']
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
        z.writestr("indexes/one.cdxj", lines[0] + "\n")
        z.writestr("indexes/two.cdx.gz", gzip.compress(lines[1].encode()))
        z.writestr("indexes/notes.txt", "{not an index")
    whole = out.getvalue()
    assert [whole[o: o + n] for o, n in warczip.located(io.BytesIO(whole), len(whole))] == [b"AAAA", b"BBBBBBB"]
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/three.cdxj", 'k 1 {"filename": "gone.warc.gz", "offset": 0, "length": 1}')
    with pytest.raises(ValueError, match="gone"):
        warczip.located(io.BytesIO(out.getvalue()), len(out.getvalue()))


def test_zip64_end_record():
    body = warczip.package([("k", b"abc")])
    k = body.rfind(warczip.EOCD)
    count, length, start = struct.unpack_from("<HII", body, k + 10)
    end64 = warczip.EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    locator = warczip.LOCATOR64 + struct.pack("<IQI", 0, k, 1)
    end = warczip.EOCD + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = body[:k] + end64 + locator + end
    assert warczip.members(*as_file(wide)) == warczip.members(*as_file(body))
    for broken in (b"", b"no archive at all", body[:-30]):
        with pytest.raises(ValueError):
            warczip.members(*as_file(broken))


def lcs_matches(a, b):
    """Matched words of the best local alignment without a band (match 2, else -1)."""
    best, rows = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b):
            s = max([(rows[j][0] + (2 if x == y else -1), rows[j][1] + (x == y)), (rows[j + 1][0] - 1, rows[j + 1][1]), (new[j][0] - 1, new[j][1])], key=lambda o: o[0])
            new.append(s if s[0] > 0 else (0, 0))
            best = max(best, new[-1], key=lambda o: o[0])
        rows = new
    return best[1]


def test_scan_matches_unbanded_alignment(spark):
    rnd = random.Random(6)
    notice = licenses.TEMPLATES["MIT-text"]
    rows, words = [], "sea sun wind rock tree".split()
    for i in range(40):
        w = notice.split()
        for _ in range(i % 6):
            k = rnd.randrange(len(w))
            w[k: k + 1] = [[], ["odd"], [w[k], "more"]][rnd.randrange(3)]
        rows.append((i, " ".join([rnd.choice(words) for _ in range(rnd.randint(0, 90))] + w + [rnd.choice(words) for _ in range(5)])))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).filter("license = 'MIT-text'").collect()}
    for i, t in rows:
        a, b = licenses.words_of(notice).tolist(), licenses.words_of(t).tolist()
        assert got[i]["matched"] == lcs_matches(a, b) and got[i]["coverage"] == got[i]["matched"] / len(a)


def test_scan_spans_and_edge_rows(spark):
    text = "é\n\"Released  under the\tMIT License.\" and again RELEASED UNDER THE MIT LICENSE"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "Released under"), (5, "the sea " * 60_000 + "Licensed under CC BY-NC 4.0."),
            (6, "Released under the sea"), (7, "This work is licensed under the GNU Public License, version 3")]
    got = sorted(((r["doc_id"], r["license"], round(r["coverage"], 3), r["start_word"], r["end_word"], r["start_char"], r["end_char"])
                  for r in licenses.scan(frame(spark, rows)).collect()), key=str)
    span = [("MIT", 1.0, 1, 6, 3, 34), ("MIT", 1.0, 8, 13, text.index("RELEASED"), len(text))]
    want = [(i, *s) for i in (1, 1, None) for s in span] + [(5, "CC-BY-NC-4.0", 1.0, 120_000, 120_007, 480_000, 480_027), (7, "GPL-3.0", 0.917, 0, 11, 0, 61)]
    assert got == sorted(want, key=str)
    assert licenses.scan(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.build_index({"tiny": "two words"})


def cell_by_cell(a, b, shift, band):
    """The banded local alignment written out: (score, matched) of the best cell."""
    score, best = {}, (0, 0)
    for i, x in enumerate(a):
        for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1)):
            diagonal = score.get((i - 1, j - 1), (0, 0))
            diagonal = diagonal if diagonal[0] > 0 else (0, 0)
            options = [(diagonal[0] + (2 if b[j] == x else -1), diagonal[1] + (b[j] == x))]
            options += [(s - 1, h) for s, h in (score.get((i - 1, j), (-9, 0)), score.get((i, j - 1), (-9, 0)))]
            s, h = max(options, key=lambda o: o[0])
            score[i, j] = (s, h) if s > 0 else (0, 0)
            best = max(best, score[i, j], key=lambda o: o[0])
    return best


def test_alignment_equals_the_written_out_form():
    rnd = random.Random(12)
    for _ in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randint(1, 14))]
        b = [rnd.randrange(4) for _ in range(rnd.randint(0, 18))]
        shift, band = rnd.randint(-6, 8), rnd.randint(0, 6)
        matched, start, end = licenses.align(np.array(a), np.array(b, int), shift, band)
        assert matched == cell_by_cell(a, b, shift, band)[1]
        assert 0 <= start <= end <= len(b) and matched <= end - start


def test_whole_licenses_are_found_with_edits(spark):
    rnd = random.Random(9)
    rows, want = [], []
    for name, text in licenses.FULL_TEXTS.items():
        w = text.split()
        for edit in ("none", "drop", "insert", "spread"):
            v = list(w)
            if edit == "drop":
                del v[30: 30 + len(w) // 8]
            elif edit == "insert":
                v[40:40] = ["of", "our", "company"] * 2
            elif edit == "spread":
                for k in range(5, len(v), 12):
                    v[k] = "zzz"
            want.append((len(rows), name))
            rows.append((len(rows), " ".join(["sea"] * rnd.randint(0, 50) + ["Copyright", "2020"] + v + ["int", "main"])))
    rows.append((len(rows), "permission is granted to anyone to use the software and the following conditions " * 40))
    got = licenses.scan(frame(spark, rows)).collect()
    found = {(r["doc_id"], r["license"]): r["coverage"] for r in got}
    assert set(want) <= set(found) and not any(r["doc_id"] == len(rows) - 1 for r in got)
    assert all(found[k] == 1.0 for k in want[::4])
    for (doc, name), (_, text) in zip(want, [rows[d] for d, _ in want]):
        a, b = licenses.words_of(licenses.FULL_TEXTS[name]).tolist(), licenses.words_of(text).tolist()
        assert found[doc, name] <= lcs_matches(a, b) / len(a)


def test_every_one_word_edit_is_found(spark):
    rows, want = [], set()
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        n = len(licenses.words_of(text))
        for k in range(len(words)):
            for new in ([*words[:k], "otherword", *words[k + 1:]], [*words[:k], "otherword", *words[k:]]):
                lost = n - len(licenses.words_of(words[k])) if len(new) == len(words) else n
                if lost >= 0.8 * n:
                    want.add((len(rows), name))
                rows.append((len(rows), "some words before " + " ".join(new) + " and after"))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert want <= got
