"""Decontamination, WARC archives and token files: brute force, round trips, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import decontaminate, token_scan, warc

TEXTS = "doc_id long, text string"
ITEMS = "item_id long, text string"


class TestDecontamination:
    def brute(self, text, items):
        words = decontaminate.words_of(text)
        hit, found = set(), set()
        for item, body in items:
            own = decontaminate.words_of(body)
            n = min(10, len(own))
            for i in range(len(own) - n + 1 if own else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        return len(words), len(hit), sorted(found)

    def cases(self):
        draw = random.Random(5)
        word = lambda: draw.choice(["a", "b", "Ça", "x1", "the"])
        text = lambda n: " ".join(word() for _ in range(n))
        items = [(i, text(n)) for i, n in enumerate((3, 9, 10, 11, 14, 25, 12, 12))] + [(20, "once"), (21, "..."), (22, None), (7, None)]
        docs = [text(n) for n in (0, 1, 2, 9, 10, 30, 200)]
        docs += [f"{text(4)}, {body}! {text(4)}".upper() for _, body in items if body] + [None, "ONCE"]
        return list(enumerate(docs)), items

    @pytest.mark.parametrize("max_words", [10**6, 30])
    def test_against_brute_force(self, spark, max_words):
        docs, items = self.cases()
        # upper-casing touched letters beyond A-Z, which fold leaves alone
        found = decontaminate.find_hits(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, ITEMS), max_words=max_words)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
        assert got == {i: self.brute(t, items) for i, t in docs}
        assert any(n for _, n, _ in got.values()) and not all(n for _, n, _ in got.values())

    def test_empty_tables_repeats_and_clashing_names(self, spark):
        docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, "c", 7)], TEXTS + ", n_hit int")
        none = spark.createDataFrame([], ITEMS)
        assert [tuple(r)[2:] for r in decontaminate.find_hits(docs, none).collect()] == [(2, 0, [], [], [], False)] * 2 + [(1, 0, [], [], [], False)]
        for size in (10**6, 1):
            items = spark.createDataFrame([(9, "b"), (9, "b"), (None, "c"), (4, "a")], ITEMS)
            got = sorted((r.doc_id or 0, r.n_hit, r["items"], r.starts, r.ends) for r in decontaminate.find_hits(docs, items, max_words=size).collect())
            spans = {True: ([0], [2])}[True]
            assert got[0] == (0, 0, [], [], [])
            assert [g[:3] for g in got[1:]] == [(1, 2, ["4", "9"])] * 2
            assert size == 1 or (got[1][3], got[1][4]) == spans
        assert decontaminate.find_hits(docs.limit(0), items).collect() == []

    def test_shifts_never_skip(self):
        draw = random.Random(1)
        for _ in range(300):
            length = draw.randint(1, 12)
            items = [("i", " ".join(draw.choices("ab", k=draw.randint(1, 14)))) for _ in range(4)]
            text = " ".join(draw.choices("ab", k=40))
            tables = decontaminate.compile_tables(items, length)
            words = decontaminate.words_of(text)
            for table in tables:
                got = [s for s, _ in decontaminate.occurrences(words, table)]
                every = [j for j in range(len(words) - table.length + 1) if any(words[j : j + table.length] == p for heads in table.buckets.values() for ps in heads.values() for p, _ in ps)]
                assert sorted(set(got)) == every


class TestWarc:
    PAGES = "page_id long, url string, html string"

    def test_round_trip(self, spark, tmp_path):
        long = "é" * 600
        pages = [(1, "http://a/ü x", long), (2, None, long), (3, "http://c", "short"), (4, "http://d", "short"), (5, "u", None), (6, "u", ""), (None, "n", "x" * 2000), (8, "n", long + "!"), (2, "again", long), (9, "big", "ab" * 3_000_000)]
        df = spark.createDataFrame(pages, self.PAGES).withColumn("payload", F.lit("clash"))
        got = warc.archive_pages(df, f"file://{tmp_path}", payloads=True).collect()
        by_id = {(r.page_id, r.url): r for r in got}
        assert len(got) == len(pages)
        first = by_id[1, "http://a/%C3%BC%20x"]
        assert (first.record_type, first.refers_to, first.payload, first.payload_bytes) == ("revisit", 2, None, 1200)
        assert [by_id[2, u].record_type for u in (None, "again")] == ["response"] * 2
        assert {r.record_type for r in got if r.payload_bytes < 1000} == {"response"}
        for r in got:
            html = next(h for i, u, h in pages if i == r.page_id) or ""
            assert r.payload_bytes == len(html.encode())
            assert r.payload_digest == warc.hashlib.sha1(html.encode()).hexdigest()
            assert r.payload is None or bytes(r.payload) == html.encode()
        assert by_id[None, "n"].refers_to is None

    def test_streams_become_members(self, spark, tmp_path):
        pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 50) as html")
        archives = warc.write_archives(warc.plan_records(pages.coalesce(1)), f"{tmp_path}/a", archive_bytes=4000)
        assert archives.agg(F.sum("records")).first()[0] == 40 and archives.count() > 3
        for r in archives.collect():
            data = zlib.decompressobj(31)
            data.decompress(open(r.path, "rb").read())
            assert data.eof and not data.unused_data  # one member
        new = warc.normalise(archives, f"{tmp_path}/b")
        index = warc.read_index(new)
        assert index.count() == 40
        for r in index.collect():
            with open(r.path, "rb") as f:
                f.seek(r.offset)
                member = zlib.decompressobj(31)
                assert member.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
                assert member.eof and not member.unused_data
        # files that no table lists are not read
        (tmp_path / "b" / "stray.idx").write_text('{"path": "gone", "offset": 0, "length": 1}\n')
        assert warc.read_records(warc.read_index(new)).count() == 40

    def test_ids_come_back_as_they_went_in(self, spark, tmp_path):
        long = "x" * 1500
        ids = ["", None, "b>\r\nWARC-Type: revisit", "é ü/%41>", " a ", "<urn:page:7>", "z"]
        pages = [(i, "u", f"{n} {long}") for n, i in enumerate(ids)] + [("", "u", "same" + long), ("\r\n", "u", "same" + long), (None, "u", "same" + long)]
        got = warc.archive_pages(spark.createDataFrame(pages, "page_id string, url string, html string"), str(tmp_path)).collect()
        want = [(i, "response", None) for i in ids] + [("", "revisit", "\r\n"), ("\r\n", "response", None), (None, "revisit", "\r\n")]
        assert sorted([(r.page_id, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
        # the empty id may be the largest of its copies
        pages = [("", "u", long), (None, "u", long)]
        got = warc.archive_pages(spark.createDataFrame(pages, "page_id string, url string, html string"), str(tmp_path)).collect()
        assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("", "response", None), (None, "revisit", "")}

    def test_damage_is_noticed(self):
        good = warc.record(1, "u", b"payload", None)
        assert warc.parse(zlib.compress(good, wbits=31))["payload"] == b"payload"
        with pytest.raises(ValueError, match="damaged"):
            warc.parse(zlib.compress(good.replace(b"payload\r", b"pAyload\r"), wbits=31))

    def test_stream_over_members_and_small_pieces(self, monkeypatch):
        monkeypatch.setattr(warc, "PIECE", 7)
        body = bytes(range(256)) * 40
        data = zlib.compress(b"H: 1\r\n\r\n" + body, wbits=31) + zlib.compress(b"I: 2\r\n\r\nxy", wbits=31)
        stream = warc.Stream(__import__("io").BytesIO(data))
        assert stream.header() == b"H: 1\r\n\r\n" and b"".join(stream.pieces(len(body))) == body
        assert stream.header() == b"I: 2\r\n\r\n" and b"".join(stream.pieces(2)) == b"xy"
        assert stream.header() is None

    def test_empty(self, spark, tmp_path):
        assert warc.archive_pages(spark.createDataFrame([], self.PAGES), str(tmp_path)).collect() == []


class TestTokenScan:
    @pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
    def test_blocks_are_stitched(self, spark, tmp_path, block):
        draw, truth, paths = random.Random(3), {}, []
        for name, tail in (("a", 0), ("b", 3), ("c", 0)):
            counts = [draw.choice([0, 0, 1, 5, 40]) for _ in range(30)] if name != "c" else []
            ids = [x for n in counts for x in [1] * n + [9]] + [2] * tail
            path = tmp_path / name
            np.array(ids, "<u2").tofile(path)
            paths.append((str(path),))
            truth |= {(str(path), i): n for i, n in enumerate(counts + [tail] * bool(tail))}
        found = token_scan.scan(spark.createDataFrame(paths * 2, "path string"), separator=9, block_bytes=block)
        assert {(r.path, r.ordinal): r.n_tokens for r in found.collect()} == truth

    def test_counts_equal_the_tokenizer(self, spark, tmp_path):
        texts = ["", None, "a b", "<|endoftext|> é 日本", "x" * 5000, "w " * 20000, "a b"]
        docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] + [(None, "q")], TEXTS).withColumn("path", F.lit(1))
        encoding = token_scan.load(token_scan.RANKS)
        got = token_scan.count_tokens(docs, folder=str(tmp_path), block_bytes=1024)
        size = lambda t: len(encoding.encode_ordinary(t or ""))
        expected = [(i % 6, size(t)) for i, t in enumerate(texts)] + [(None, size("q"))]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)

    def test_files_roll_and_empty_table(self, spark, tmp_path):
        docs = spark.range(50).selectExpr("id as doc_id", "repeat('word ', cast(id as int)) as text").coalesce(1)
        placed = token_scan.write_tokens(docs, f"{tmp_path}/t", file_tokens=100)
        assert placed.select("path").distinct().count() > 5
        assert token_scan.scan(placed).agg(F.count("*")).first()[0] == 50
        assert token_scan.count_tokens(docs.limit(0), folder=str(tmp_path)).collect() == []
