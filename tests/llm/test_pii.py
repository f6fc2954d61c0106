"""Base spans against plain regular expressions; discovery on a corpus with a telling context."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string, lang string, spans int"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


CASES = [
    None, "", "a@b.c", "a@b.c@d.e", "x.y@z..w q@r.s-t_u@v.w", "é a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4539 1488 0343 6467 and 4539-1488-0343-6468", "+1 (499) 555-6503 +12 +1-2-3",
    "+49 30 1234567890123456", "9" * 40, "a" * 3000 + "@", "a@" + "b." * 5000 + "c", "1.1.1.1@2.2.2.2", "\U0001f600 a@b.cd \U0001f600 +1 222 333 4444",
]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(CASES)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(CASES):
        assert got[i].base_sha256 == hashlib.sha256(plain(t).encode()).hexdigest(), t
        assert got[i].n_email == plain(t).count("email:")


def test_random_texts(spark):
    texts = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(alphabet="ab@.-+ 0123459()_%é", max_size=60))
    def gather(t):
        texts.append(t)

    gather()
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(plain(t).encode()).hexdigest(), repr(t)


def test_a_telling_context_finds_unseen_identifiers_and_prose_does_not(spark):
    seeds = [(i, f"word{'s' * (i % 3)} the phone: +1 (2{i:02d}) 555-01{i:02d} and more of it", "en", 1) for i in range(30)]
    unseen = [(100, "call phone: 0221 555 7788 today", "en", 1), (101, "it cost the 12345678 of them", "en", 1)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(seeds + unseen, DOCS)).collect()}
    assert got[100].n_phone == 0 and got[100].spans == "phone:12:25" and got[100].n_found == 1
    assert got[101].spans == ""
    assert all(got[i].n_phone == 1 and got[i].spans.startswith("phone:") for i in range(30))


def test_full_stops_and_commas_introduce_nothing(spark):
    seeds = [(i, f"one may call +1 (2{i:02d}) 555-01{i:02d}. it is open. all is well. so it goes.", "en", 1) for i in range(30)]
    commas = [(50 + i, f"reach +1 (3{i:02d}) 555-01{i:02d}, or come, or write, or wait", "en", 1) for i in range(30)]
    glued = [(200 + i, f"tel:+1 (4{i:02d}) 555-01{i:02d} w{i}", "en", 1) for i in range(30)]
    odd = [(100, "on 2024-01-15. Then", "en", 1), (101, "by 2024-01-16, perhaps", "en", 1), (102, "tel:0221 555 7788 here", "en", 1)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(seeds + commas + glued + odd, DOCS)).collect()}
    assert got[100].spans == "" and got[101].spans == ""
    assert got[102].spans == "phone:4:17" and got[102].n_found == 1


def test_repeated_and_null_ids_stay_apart(spark):
    rows = [(None, "a@b.cd", "en", 1), (None, None, None, None), (1, "a@b.cd", "en", 1), (1, "a@b.cd", "en", 1)]
    assert sorted(r.n_email for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()) == [0, 1, 1, 1]
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_planted_identifiers_are_found_with_precision(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, planted, decoys = [], {}, 0
    for i in range(600):
        number = f"{r.randrange(10)}{r.randrange(100, 1000)} {r.randrange(100, 1000)} {r.randrange(1000, 10000)}"
        lead = r.choice(["call mobile no", "ring hotline :", "fax me at"])
        what = r.randrange(4)
        if what == 0:  # a seed
            texts.append(f"{prose(9)} {lead} +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} {prose(6)}")
        elif what == 1:  # the same contexts, another form
            head = f"{prose(7)} {lead} "
            planted[i] = f"phone:{len(head)}:{len(head) + len(number)}"
            texts.append(f"{head}{number} {prose(5)}")
        else:  # numbers of other kinds among prose
            decoys += 1
            texts.append(f"{prose(8)} {number if what == 2 else r.randrange(10**7, 10**9)} {prose(8)}")
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    hits = sum(got[i].spans == s for i, s in planted.items())
    wrong = sum(x.n_found for i, x in got.items() if i not in planted)
    assert hits >= 0.95 * len(planted) and wrong <= 0.02 * hits, (hits, len(planted), wrong, decoys)


def test_what_is_found_teaches_further_contexts(spark):
    rows = [(i, f"dial mobile no +1 (2{i:02d}) 555-01{i:02d} now w{i}", "en", 1) for i in range(40)]
    both = [f"02{k}1 555 77{k}{k}" for k in range(8)]
    rows += [(100 + k, f"dial mobile no {x} now v{k}", "en", 1) for k, x in enumerate(both)]
    rows += [(200 + k, f"u{k} durchwahl buero {x} bitte anrufen", "en", 1) for k, x in enumerate(both)]
    rows += [(300, "a durchwahl buero 0999 123 4567 bitte anrufen", "en", 1)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[200 + k].n_found == 1 for k in range(8)) and got[300].spans == "phone:18:31"


def test_long_neighbours_give_no_pattern_and_long_texts_are_read(spark):
    end = "x" * 40
    rows = [(i, f"{chr(97 + i % 26) * 70}{end} +1 (2{i:02d}) 555-01{i:02d} {end}{chr(97 + i % 26) * 70}", "en", 1) for i in range(30)]
    rows += [(100, f"{'z' * 100}{end} 0221 555 7788 {end}{'y' * 100}", "en", 1), (101, "word " * 300_000 + "a@b.cd", "en", 1)]
    rows += [(102, "".join(f"a{k}@b.cd,{k % 256}.1.1.1;" for k in range(3000)), "en", 1)]
    got = {x.doc_id: x for x in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100].spans == "" and got[101].spans == "email:1500000:1500006" and (got[102].n_email, got[102].n_ip) == (3000, 3000)
