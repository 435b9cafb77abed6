"""Operators that are SQL: edge cases, and the queries beside their SQL."""

import hashlib
import os
import time

import duckdb
import pytest

from medloom.llm import exact_dedup, line_dedup, mixing, preferences, queries, url_rules

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    answer = con.execute(queries.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    tidy = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(tidy, found.select(*names).collect()), key=repr) == sorted(map(tidy, answer.fetchall()), key=repr)


class TestExactDedup:
    def test_null_case_and_ties(self, spark):
        docs = spark.createDataFrame(
            [(1, "Ab", "x"), (2, "aB", None), (3, None, "x"), (4, "", "x"), (5, "É", "x"), (6, "é", "x"), (None, "ab", "x"), (2, "ab", "x")],
            DOCS,
        ).withColumn("keep_id", mixing.F.lit(0))
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
        assert got == {
            (1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False),
            (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True),
        }

    def test_all_null_ids_and_digest(self, spark):
        got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "A"), (None, "a")], "doc_id long, text string")).collect()
        assert {(r.keep_id, r.group_size, r.kept) for r in got} == {(None, 2, True)}
        assert got[0].text_sha256 == hashlib.sha256(b"a").hexdigest()

    def test_empty_table(self, spark):
        assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []

    def test_directory_doubles_where_buckets_overflow(self, spark):
        # 40 keys with leading bits 000, 2 with 100
        keys = [(i,) for i in range(40)] + [((-1 << 63) + i,) for i in range(2)]
        slots = {r.slot: r.bucket for r in exact_dedup.directory(spark.createDataFrame(keys, "key long"), 3, 8).collect()}
        # slot 0 is split to the full depth, and its siblings on the way
        assert slots == {0: 8, 1: 9, 2: 5, 3: 5, 4: 3, 5: 3, 6: 3, 7: 3}

    def test_small_buckets_give_the_same_result(self, spark):
        docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id % 120) as text")
        found = exact_dedup.exact_dedup(docs, capacity=4).collect()
        assert len(found) == 500
        assert all(r.keep_id % 120 == r.doc_id % 120 and r.keep_id >= 360 for r in found)


    def test_owners_decide_by_bytes(self, spark):
        # texts of one key, as if their hashes were equal, in several tasks
        rows = spark.range(90).selectExpr("id", "concat('t', id % 3) as t", "id % 2 as key").repartition(6)
        index, slots, depth = exact_dedup.build_index(rows, 1)
        assert depth == 5 and slots.count() == 32
        found = {(r.key, e.keep_id, e.group_size, e.digest) for r in index.collect() for e in r.chain}
        sha = lambda i: hashlib.sha256(b"t%d" % i).hexdigest()
        assert found == {(k, max(i for i in range(90) if i % 2 == k and i % 3 == t), 15, sha(t)) for k in (0, 1) for t in range(3)}

    def test_long_text_and_clashing_names(self, spark):
        docs = [(1, "A" * 3_000_000), (2, "a" * 3_000_000), (3, "a" * 3_000_000 + "b")]
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as t", "'x' as key", "0 as bucket", "0 as slot")
        assert [(r.keep_id, r.group_size) for r in sorted(exact_dedup.exact_dedup(df).collect())] == [(2, 2), (2, 2), (3, 1)]

    def test_given_tables_double_the_directory(self, spark):
        docs = spark.range(1000).selectExpr("id", "cast(id as string) as t", "xxhash64(id) as key")
        index, slots, depth = exact_dedup.build_index(docs, exact_dedup.CAPACITY)
        assert slots.select("bucket").distinct().count() > 1
        filled = {r.bucket: r["n"] for r in index.groupBy("bucket").agg(mixing.F.count("*").alias("n")).collect()}
        assert sum(filled.values()) == 1000 and max(filled.values()) <= exact_dedup.CAPACITY


class TestMixing:
    def test_targets_stop_and_excess_is_reshared(self, spark):
        # weights 5, 2, 1 of 1000 words; the first source stops at 30
        sizes = spark.createDataFrame([("a", 10), ("b", 490), ("c", 500)], "source string, source_size long")
        got = {r.source: (r.target, r.budget) for r in mixing.budgets(sizes).collect()}
        assert got["a"] == (30.0, 30)
        assert got["b"][0] == pytest.approx(970 * 2 / 3) and got["c"][0] == pytest.approx(970 / 3)

    def test_budgets_are_exact_and_reruns_agree(self, spark):
        docs = spark.range(300).selectExpr(
            "id as doc_id", "array_join(array_repeat('w', cast(id % 17 as int)), ' ') as text",
            "case when id % 3 = 0 then null else concat('s', id % 5) end as source", "1 as taken", "'q' as target",
        )
        first = mixing.mix(docs, per_cell=8)
        assert first.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
        assert rows(first) == rows(mixing.mix(docs.repartition(7), per_cell=1000))
        by_source = first.groupBy("source").agg(
            mixing.F.sum("taken").alias("taken"), mixing.F.first("target").alias("target"), mixing.F.sum("size").alias("size")
        )
        for r in by_source.collect():
            assert r.taken == round(r.target) <= 3 * r.size
        assert first.where("taken > 3 * size").isEmpty()

    def test_nulls_empty_texts_and_repeated_rows(self, spark):
        docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "\u00a0x y", "a"), (2, "\u00a0x y", "a")], DOCS)
        got = rows(mixing.mix(docs).select("doc_id", "size", "taken"))
        assert got == [(1, 0, 0), (2, 2, 2), (2, 2, 2), (None, 0, 0)]
        assert mixing.mix(docs.limit(0)).collect() == []

    def test_copies_are_cut_at_a_word(self, spark):
        mixed = spark.createDataFrame([(1, " a  b\nc", 3, 7), (2, "x", 1, 0)], "doc_id long, text string, size long, taken long")
        got = sorted((r["copy"], r.text) for r in mixing.materialise(mixed).collect())
        assert got == [(0, " a  b\nc"), (1, " a  b\nc"), (2, " a")]


class TestUrlRules:
    PAGES = "page_id long, url string"

    def judge(self, spark, urls, rules=None):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], self.PAGES)
        table = rules and url_rules.rule_table(spark, rules)
        return [tuple(r)[1:] for r in sorted(url_rules.judge(pages, table).collect(), key=lambda r: r.page_id)]

    def test_hosts_paths_and_nesting(self, spark):
        urls = [
            "http://WWW.Example.org/es/x?q#f", "https://example.org/en/17", "http://notexample.org/es/", "http://a.com/fr/1",
            "http://a.com/de/1", "http://a.com/", "http://example.org", None, "no scheme", "http://org/", "x://e.orgx/a",
        ]
        assert self.judge(spark, urls) == [
            ("www.example.org", "/es/x", "example.org/es/", "block"),
            ("example.org", "/en/17", "example.org/en/1", "block"),
            ("notexample.org", "/es/", "org/", "allow"),
            ("a.com", "/fr/1", "com/fr/", "allow"),
            ("a.com", "/de/1", "com/de/", "block"),
            ("a.com", "/", None, "allow"),
            ("example.org", "", None, "allow"),
            ("", "", None, "allow"),
            ("", "", None, "allow"),
            ("org", "/", "org/", "allow"),
            ("e.orgx", "/a", None, "allow"),
        ]

    def test_against_every_rule(self, spark):
        rules = [("block", "b.c/x"), ("allow", "b.c/xy"), ("block", "c/"), ("allow", "a.b.c"), ("block", "a.b.c/x"), ("allow", "d/q"), ("block", "d/q"), (None, None)]
        urls = [f"h://{h}/{p}" for h in ("a.b.c", "b.c", "z.b.c", "c", "d", "b", "e.d") for p in ("", "x", "xyz", "q")]

        def best(url):
            host, _, path = url.partition("://")[2].partition("/")
            path = "/" + path
            fits = []
            for verdict, rule in rules:
                if rule:
                    h, slash, p = rule.partition("/")
                    if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                        fits.append((len(rule), len(h), rule, verdict))
            return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

        assert self.judge(spark, urls, rules) == [best(u) for u in urls]

    def test_empty(self, spark):
        assert self.judge(spark, ["http://a/"], [("block", "b/")]) == [("a", "/", None, "allow")]
        assert url_rules.judge(spark.createDataFrame([], self.PAGES)).collect() == []


class TestPreferences:
    TURNS = "pair_id long, turn long, role string, text string"

    def test_prefix_is_rendered_once(self, spark):
        shared = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?")]
        chosen = shared + [(1, 2, "user", "a"), (1, 3, "assistant", "good"), (2, 0, "user", "q")]
        rejected = shared + [(1, 2, "user", "a"), (1, 3, "assistant", "bad"), (1, 4, "user", "why"), (2, 0, "user", "other")]
        turns = preferences.preference_turns(spark.createDataFrame(chosen, self.TURNS), spark.createDataFrame(rejected, self.TURNS))
        assert rows(turns.select("pair_id", "part", "turn")) == [
            (1, "chosen", 3), (1, "prompt", 0), (1, "prompt", 1), (1, "prompt", 2), (1, "rejected", 3), (1, "rejected", 4),
            (2, "chosen", 0), (2, "rejected", 0),
        ]
        record = preferences.records(turns).where("pair_id = 1").first()
        assert record.prompt == "<|user|>\nhi\n<|assistant|>\nyes?\n<|user|>\na\n"
        assert record.rejected == "<|assistant|>\nbad\n<|user|>\nwhy\n"
        cut = lambda text, spans: [text[s.start : s.end] for s in spans]
        assert cut(record.chosen, record.chosen_spans) == ["good\n"]
        assert cut(record.rejected, record.rejected_spans) == ["bad\n"]

    def test_nulls_repeats_and_equal_sides(self, spark):
        one = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "b")]
        side = spark.createDataFrame(one, self.TURNS)
        got = rows(preferences.preference_turns(side, side).select("pair_id", "part", "turn", "n", "text"))
        assert got == [
            (1, "prompt", 0, 1, "<|user|>\na\n"), (1, "prompt", 0, 2, "<|user|>\na\n"),
            (1, "prompt", None, 1, "<||>\n\n"), (None, "prompt", 0, 1, "<|user|>\nb\n"),
        ]

    def test_missing_side_and_empty(self, spark):
        side, none = spark.createDataFrame([(1, 0, "assistant", "a")], self.TURNS), spark.createDataFrame([], self.TURNS)
        assert [tuple(r) for r in preferences.preference_turns(none, side).collect()] == [
            (1, "rejected", 0, 1, "assistant", "<|assistant|>\na\n", 14)
        ]
        assert preferences.preference_turns(none, none).collect() == []


class TestLineDedup:
    def texts(self, spark, docs, **options):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, **options).collect()}

    def test_variable_fields_generalise(self, spark):
        docs = [(i, f"own {chr(97 + i) * 3} words here\nThis is  page {i} of the long report") for i in range(4)]
        got = self.texts(spark, docs)
        assert got[0] == ("own aaa words here\nThis is  page 0 of the long report", 2, 0)
        assert [got[i] for i in (1, 2, 3)] == [(f"own {chr(97 + i) * 3} words here", 2, 1) for i in (1, 2, 3)]

    def test_names_generalise_in_a_leaf_but_prose_does_not(self, spark):
        names = ["ann", "bob", "cid", "dan"]
        docs = [(i, f"posted by user {n} on the public list") for i, n in enumerate(names)]
        docs += [(10 + i, f"posted by user {n} {n}a {n}b {n}c {n}d") for i, n in enumerate(names)]
        got = self.texts(spark, docs)
        assert [got[i][2] for i in range(4)] == [0, 1, 1, 1]
        assert [got[10 + i][2] for i in range(4)] == [0, 0, 0, 0]

    def test_rows_of_different_numbers_stay(self, spark):
        docs = [(1, "order 12 34 56\nTotal: 1,234"), (2, "order 7 8 9\nTotal: 999"), (3, "order 1 2 3\n7 8 9"), (4, "Order  1 2 3\n3 4 5")]
        got = self.texts(spark, docs)
        assert {i: t for i, (t, _, _) in got.items()} == {**dict(docs[:3]), 4: "3 4 5"}

    def test_two_documents_and_repeats_within_one(self, spark):
        got = self.texts(spark, [(1, "x y z\nx y z\nx y z"), (2, "x y z\nown"), (3, "other\nother")])
        assert got == {1: ("x y z", 3, 2), 2: ("own", 2, 1), 3: ("other\nother", 2, 0)}
        got = self.texts(spark, [(1, "x y z\nx y z\nx y z"), (2, "x y z"), (3, "other")], min_docs=3)
        assert all(n == 0 for _, _, n in got.values())
        got = self.texts(spark, [(1, "x y z\nx y z"), (2, "x y z"), (3, "X  y z")])
        assert got == {1: ("x y z", 2, 1), 2: ("", 1, 1), 3: ("", 1, 1)}

    def test_nulls_blank_lines_repeated_rows_and_clashing_names(self, spark):
        docs = [(1, None, 0), (2, "", 0), (3, "\n \nsame line\n", 0), (4, "same line", 0), (5, "same line\n\nx", 0), (5, "same line\n\nx", 0), (None, "same line", 0)]
        df = spark.createDataFrame(docs, "doc_id long, text string, n_lines int")
        got = rows(line_dedup.dedup_lines(df))
        assert got == [
            (1, None, 0, 0), (2, "", 0, 0), (3, "\n \nsame line\n", 1, 0), (4, "", 1, 1), (5, "\nx", 2, 1), (5, "\nx", 2, 1),
            (None, "same line", 0, 0),
        ]
        assert line_dedup.dedup_lines(df.limit(0)).collect() == []

    def test_many_lines_and_many_tokens_are_linear(self, spark):
        # every other line recurs; a line of many tokens has many varying places
        letters = str.maketrans("0123456789", "abcdefghij")
        many = [f"{i} line {i * 7} of the text".translate(letters) for i in range(500_000)]
        mine = [line if i % 2 else f"own {i}".translate(letters) for i, line in enumerate(many)]
        rows = [(1, "\n".join(many)), (2, "\n".join(mine))]
        rows += [(i, " ".join(f"t{'abcd'[i % 4]}" if j % 6 == 5 else "c" for j in range(200_000))) for i in (3, 4, 5)]
        began = time.time()
        got = self.texts(spark, rows)
        assert time.time() - began < 120
        assert got[2][1:] == (500_000, 250_000) and got[1][2] == 0
        assert [got[i][2] for i in (3, 4, 5)] == [0, 1, 1]

    def test_a_long_token_is_linear(self, spark):
        long = "a" * 1_000_000
        got = self.texts(spark, [(1, long + "1"), (2, long), (3, "7" * 1_000_000)])
        assert [got[i][1:] for i in (1, 2, 3)] == [(1, 0)] * 3
