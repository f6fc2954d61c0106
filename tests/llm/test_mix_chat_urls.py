"""Mixing, preference formatting and URL filters, and the pipeline's stages."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2) for i, t, s in rows], DOCS)


# ------------------------------------------------------------------------------------------ mixing
def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()) * share, {}
    while True:
        free = [s for s in names if s not in capped]
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return {**capped, **now}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def corpus(seed=1, n=300):
    r = random.Random(seed)
    pick = ["hot"] * 6 + ["b", "c", None, "d\U0001f600"]
    return [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 700]))), r.choice(pick)) for i in range(n)]


def test_targets_and_taken(spark):
    rows = corpus() + [(9999, None, "empty"), (9998, " \t", "empty")]
    got = mixing.taken_words(mixing.plan_mix(docs_of(spark, rows), block=64, shard_slots=16)).collect()
    again = mixing.taken_words(mixing.plan_mix(docs_of(spark, rows).repartition(7), block=64, shard_slots=16)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        x = spark.range(n).select("id", mixing._swap_or_not(F.col("id"), F.lit(n).cast("long"), [F.lit(3), F.lit("s")]).alias("p"))
        back = x.select("id", "p", mixing._swap_or_not(F.col("p"), F.lit(n).cast("long"), [F.lit(3), F.lit("s")], inverse=True).alias("q")).collect()
        assert sorted(r.p for r in back) == list(range(n)) and all(r.q == r.id for r in back)


def test_shards_hold_their_slots_and_draws_vary(spark):
    mix = mixing.plan_mix(docs_of(spark, corpus(2)), block=16, shard_slots=32)
    slots = mix.slots.collect()
    per = Counter(r.shard for r in slots)
    assert all(n == 32 for k, n in per.items() if k < max(per)) and set(per) == set(range(len(per)))
    by = defaultdict(list)
    for r in slots:
        by[r.skey].append(r.ordinal)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({c for c in Counter((r.shard, r.skey) for r in slots if r.skey == "shot").values()}) > 2


def test_mixed_documents_give_the_taken_words(spark):
    rows = [(i, f"  a{i}\n" + " ".join(f"d{i}w{k}" for k in range(30 * (i % 9))) + " ", "x" if i % 3 else None) for i in range(60)]
    docs = docs_of(spark, rows)
    options = {"block": 16, "shard_slots": 8}
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.plan_mix(docs, **options)).collect()}
    out, words = Counter(), {i: t for i, t, _ in rows}
    for r in mixing.mixed_documents(docs, **options).collect():
        assert r.text == words[r.doc_id] or r.text in words[r.doc_id]
        out[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(out)


def test_a_long_text_is_mixed_whole(spark):
    rows = [(0, " ".join(f"w{k}" for k in range(60_000)), "a"), (1, "a few words here", "b"), (2, None, "b")]
    docs = docs_of(spark, rows)
    taken = {r.doc_id: (r.size, r.taken, r.target) for r in mixing.taken_words(mixing.plan_mix(docs)).collect()}
    assert taken[0][0] == 60_000 and abs(taken[0][1] - taken[0][2]) <= 1 and taken[0][1] > 60_000
    out = [r.text for r in mixing.mixed_documents(docs).where("doc_id = 0").collect()]
    assert sum(len(t.split()) for t in out) == taken[0][1] and rows[0][1] in out and all(t in rows[0][1] for t in out)


def test_empty_mixes(spark):
    assert mixing.taken_words(mixing.plan_mix(docs_of(spark, []))).count() == 0
    got = mixing.taken_words(mixing.plan_mix(docs_of(spark, [(None, None, None), (None, None, None)]))).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
    assert sum(r.taken for r in mixing.taken_words(mixing.plan_mix(docs_of(spark, [(None, "a b", "x"), (None, "a b", "x")]))).collect()) == 6


# -------------------------------------------------------------------------------------- preferences
def test_common_prefix_is_rendered_once(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "bad\U0001f600"), (1, 4, "user", "end"), (4, 0, None, None), (None, 0, "user", "lost")]
    r = {x.pair_id: x for x in chat.format_preferences(chat.pair_by_parity(spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, pos int"))).collect()}
    assert set(r) == {0, 2}
    a = r[0]
    assert a.n_prompt_turns == 3 and a.prompt.count("<|end|>") == 3 and a.chosen == "<|assistant|>\ngood<|end|>\n" and a.complete
    lo, hi = map(int, a.rejected_mask.split(":"))
    assert a.rejected[lo:hi] == "bad\U0001f600<|end|>\n" and "end<|end|>" in a.rejected[hi:]
    assert not r[2].complete and r[2].rejected == "" and r[2].prompt == "" and r[2].chosen == "<|user|>\n<|end|>\n"


def test_equal_conversations_have_no_completions(spark):
    turns = [(c, k, "user", f"t{k}", 1) for c in (0, 1) for k in range(3)]
    x = chat.format_preferences(chat.pair_by_parity(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos int"))).first()
    assert x.n_prompt_turns == 3 and x.chosen == x.rejected == "" and x.chosen_mask == ""


def test_replies_of_neighbours_are_rejected_sides(spark):
    turns = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "r0"), (0, 3, "assistant", "b0"), (0, 4, "user", "thanks"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (2, 1, "assistant", "yes"), (4, 0, "user", "no reply"), (5, 0, "assistant", "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    r = {x.pair_id: x for x in chat.format_preferences(chat.pair_by_reply(df)).collect()}
    assert set(r) == {0, 1, 2, 4, 5}
    assert (r[0].n_prompt_turns, r[0].chosen, r[0].rejected) == (3, "<|assistant|>\nb0<|end|>\n<|user|>\nthanks<|end|>\n", "<|assistant|>\na1<|end|>\n")
    assert (r[1].n_prompt_turns, r[1].chosen, r[1].rejected) == (1, "<|assistant|>\na1<|end|>\n", "<|assistant|>\nb0<|end|>\n")
    assert (r[2].n_prompt_turns, r[2].rejected, r[2].complete) == (1, "", True)
    assert (r[4].n_prompt_turns, r[4].chosen, r[4].rejected) == (1, "", "<|assistant|>\nx<|end|>\n")
    assert (r[5].n_prompt_turns, r[5].complete) == (0, False)


def test_pairs_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, pos int"
    assert chat.format_preferences(chat.pair_by_reply(spark.createDataFrame([], schema))).count() == 0
    long = "w " * 300_000
    turns = [(0, 0, "user", long), (0, 0, "assistant", "b"), (0, 0, "assistant", "b"), (0, None, "user", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, None, "q")]
    r = {x.pair_id: x for x in chat.format_preferences(chat.pair_by_reply(spark.createDataFrame([(*t, 1) for t in turns], schema))).collect()}
    assert r[0].prompt == "" and r[0].chosen.count("<|end|>") == 4 and long in r[0].chosen and r[0].rejected == "" and not r[0].complete
    assert r[1].n_prompt_turns == 3 and r[1].chosen == "" and r[1].rejected == "<|assistant|>\nb<|end|>\n"


def test_pairs_of_the_table_share_prompts(spark):
    x = chat.format_preferences(chat.pair_by_reply(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    n, prompts, complete = x.agg(F.count("*"), F.count_if(F.col("n_prompt_turns") > 0), F.count_if("complete")).first()
    assert n == 100 and prompts >= 0.9 * n and complete == n


# --------------------------------------------------------------------------------------------- urls
def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in url_filter.DEFAULT_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_parts(spark):
    urls = [None, "", "no scheme/en/", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "https://a.example.com/en", "x://n.net/es/1", "x://net/fr/", "x://anet/fr/", "a://b://c/", "https://h?x=/en/", "https://É.net/es/\n", "https://example.com?/en/"]
    df = spark.createDataFrame([(i, u, None, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, r int")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), u
        assert got[i].verdict == (rule.verdict if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pure_templates_are_rejected_and_numbers_generalise(spark):
    rules = (url_filter.Rule("h.org", "/spam/a", "block"), url_filter.Rule("h.org", "/good/", "allow"))
    urls = [f"http://h.org/spam/a{k}/{k}" for k in range(200)] + [f"http://h.org/good/{k}" for k in range(200)] + ["http://h.org/spam/b7/9", "http://h.org/other/1", "http://k.org/spam/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.path: r for r in url_filter.judge_urls(df, rules).where("page_id >= 200").collect()}
    assert got["/other/1"].verdict == "allow" and got["/spam/a"].verdict == "allow"
    assert len({r.template for r in url_filter.judge_urls(df, rules).where("page_id < 200").collect()}) == 1
    many = [(k, f"http://h.org/x/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrstuvwxyz'[k // 26]}q/1") for k in range(676)]
    block = (url_filter.Rule("h.org", "/x/a", "block"), url_filter.Rule("h.org", "/x/b", "block"))
    got = url_filter.judge_urls(spark.createDataFrame(many, "page_id long, url string"), block).collect()
    assert {r.template for r in got} == {"/x/*/<n>"} and {r.verdict for r in got} == {"block"}


def test_sections_without_labels_join_what_they_are_like(spark):
    R = url_filter.Rule
    rules = (R("h.org", "/es/", "block"), R("h.org", "/fr/", "block"), R("k.org", "/es/", "block"), R("m.org", "/bad/", "block"), R("m.org", "/good/", "allow"))
    many = lambda base, n, end="": [f"http://{base}/{k}{end}" for k in range(n)]
    urls = many("h.org/es", 100) + many("h.org/fr", 100) + many("h.org/en", 150) + many("h.org/about", 3, "/who") + many("k.org/es", 7) + many("k.org/en", 20)
    urls += many("m.org/bad", 300) + many("m.org/good", 300) + many("m.org/other", 50)
    got = {r.host + r.path: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert {got[f"h.org/en/{k}"].verdict for k in range(150)} == {"block"} and got["h.org/en/1"].template == "/{about|en|es|fr}/<n>"
    assert got["k.org/en/1"].verdict == "allow" and got["k.org/en/1"].template == "/{en|es}/<n>"
    assert {got[f"m.org/other/{k}"].verdict for k in range(50)} == {"allow"} and got["m.org/other/1"].template == "/other/<n>"
    assert {got[f"h.org/about/{k}/who"].verdict for k in range(3)} == {"allow"}


def test_deep_and_long_paths_are_read_whole(spark):
    R = url_filter.Rule
    deep = "/".join(["a"] * 12)
    rules = (R("h.org", f"/{deep}/bad/", "block"), R("h.org", f"/{deep}/good/", "allow"), R("h.org", "/p/", "allow"))
    urls = [f"http://h.org/{deep}/bad/x/{k}" for k in range(150)] + [f"http://h.org/{deep}/good/y-{k}/z" for k in range(150)]
    urls += [f"http://h.org/p/{'s/' * 3000}end", f"http://h.org/p/{'w' * 50_000}", "http://h.org/other/" + "/".join(f"s{chr(97 + k)}" for k in range(20))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules).collect()}
    assert got[0].template != got[150].template and got[0].template.count("/") == 15
    assert got[0].blocked_share > 0.9 > 0.2 > got[150].blocked_share
    assert got[300].template.count("/") == 3002 and len(got[301].template) > 50_000 and got[302].template.count("/") == 21


def test_repeated_and_null_pages_are_judged_each(spark):
    rows = [(1, "http://net/es/1")] * 3 + [(None, "http://net/es/1"), (None, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((str(r.page_id), str(r.rule)) for r in got) == [("1", "net/es/")] * 3 + [("None", "None"), ("None", "net/es/")]


def test_few_even_siblings_become_a_wildcard(spark):
    names = [f"{a}{b}q" for a in "abcdef" for b in "ghijk"]
    urls = [f"http://h.org/s/{x}/{k}" for x in names for k in range(9)]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (url_filter.Rule("h.org", "/s/a", "block"), url_filter.Rule("h.org", "/s/b", "block"))).collect()
    assert {r.template for r in got} == {"/s/*/<n>"} and {r.verdict for r in got} == {"block"}


# ------------------------------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    words = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(120) for _ in range(20)]
    near = [b + " extra" for b in base[:5]]
    french = "le la les des une est dans que qui pour avec sur pas mais nous vous ils elle cette tout comme faire".split()
    texts = base + base[:6] + near + [" ".join(r.choice(french) for _ in range(150)) for _ in range(10)] + ["12 34", None, text(3000)]
    rows = [(i, t, None if t is None else "fr" if 31 <= i < 41 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == P.COLUMNS
        seen.append({x.doc_id for x in docs.collect()})
    language, exact, near_kept, mixed = seen
    assert language == set(range(len(texts))) - {41, 42}
    assert exact == language - set(range(20, 26))
    assert near_kept == exact - set(range(26, 31))
    assert mixed <= near_kept and len(mixed) > len(near_kept) // 2
    packed = P.run(spark, sf)
    fill = defaultdict(list)
    for x in packed.collect():
        fill[x.sequence_id].append((x.offset, x.length))
    for parts in fill.values():
        assert sum(n for _, n in parts) <= 1024 and all(o == sum(n for p, n in parts if p < o) for o, _ in parts)
