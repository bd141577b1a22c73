import random
import re

import brute
from brute import prose
from pyspark.sql import functions as F

from logloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    odd = [int(c) for c in digits(s)[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits(s)[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


VALID = (
    lambda v: True,
    lambda v: all(int(p) <= 255 for p in v.split(".")),
    lambda v: 14 <= len(digits(v)) <= 19 and luhn(v),
    lambda v: 10 <= len(digits(v)) <= 15,
)


def plain(text):
    spans = sorted(
        (m.start(), k, m.end())
        for k, pattern in enumerate((EMAIL, IP, CARD, PHONE))
        for m in pattern.finditer(text or "")
        if VALID[k](m.group())
    )
    line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*[sum(k == n for _, k, _ in spans) for n in range(4)], brute.sha(line.encode()))


def base(row):
    return (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256)


def test_base_patterns(make_docs):
    r = random.Random(11)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "_", "%", "1", "255", "256", "007", ".1", "+", "+1", " ",
             "(555)", "4111 1111 1111 1111", "4111-1111-1111-1112", "30569309025904", "é", "\U0001f600",
             "\n", "+49 (30) 1234-5678", "10.0.0.1", "@b.c_d@e.fr"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 16)))) for k in range(1500)]
    got = {x.doc_id: base(x) for x in pii.find_personal_data(make_docs(rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_long_runs(make_docs):
    """Neither deep stacks nor quadratic time."""
    runs = ["1" * 3000, "1-" * 10_000 + "1", "+1" + " " * 20_000, "1.2.3.4." * 1000,
            "x@y.zz " * 3000, "a" * 3000, "a.b" * 1000, "a@" + "b.c" * 1000]
    rows = list(enumerate(runs))
    got = {x.doc_id: base(x) for x in pii.find_personal_data(make_docs(rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}
    # too long for the plain patterns, which take quadratic time here
    rows = [(1, "a" * 300_000), (2, "a.b" * 100_000 + "@"), (3, "a@" + "b.c" * 100_000), (4, "1" * 300_000),
            (5, "10.0.0.1 " * 20_000)]
    got = {x.doc_id: (x.n_email, x.n_ip, x.spans[:16]) for x in pii.find_personal_data(make_docs(rows)).collect()}
    assert got == {1: (0, 0, ""), 2: (0, 0, ""), 3: (1, 0, "email:0:300002"), 4: (0, 0, ""),
                   5: (0, 20_000, "ip:0:8,ip:9:17,i")}


def test_bootstrapped_contexts(make_docs):
    def mail(k):
        return f"user{k}@mail{k % 7}.example.com"

    rows = [(k, f"{prose(k, 9)} please write to {mail(k)} about this {prose(k + 500, 5)}") for k in range(40)]
    rows += [(100, f"{prose(900, 9)} please write to jane(at)home9 about this"),
             (101, f"{prose(901, 9)} please write to agent.x77 about this"),
             (102, f"{prose(902, 5)} chapter 12345 is long, 99bottles of it")]
    # a context in which few of the identifiers are personal
    rows += [(200 + k, f"{prose(950 + k, 5)} see the {mail(k) if k < 3 else f'item{k}00'} now") for k in range(30)]
    got = {r.doc_id: r for r in pii.find_personal_data(make_docs(rows)).collect()}
    text = dict(rows)
    a = text[101].index("agent")
    assert got[101].spans == f"context:{a}:{a + 9}" and got[101].n_context == 1
    assert got[102].spans == "" and all(got[200 + k].n_context == 0 for k in range(30))
    assert all(got[k].n_email == 1 and got[k].n_context == 0 for k in range(40))


def test_redact(make_docs):
    rows = [(1, "write to ann@x.org or +1 (555) 123-4567, é\U0001f600 10.0.0.1!"), (2, None), (3, "plain"),
            (3, "plain 10.0.0.2"), (None, "card 4111 1111 1111 1111"), (None, "card 4111 1111 1111 1111")]
    docs = make_docs(rows).withColumn("_extra", F.lit(1))
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r.text for r in got.collect()), key=str) == sorted(
        ["write to <EMAIL> or <PHONE>, é\U0001f600 <IP>!", None, "plain", "plain <IP>", "card <CARD>", "card <CARD>"],
        key=str,
    )


def test_odd_rows(clashing, odd_rows, no_docs):
    got = pii.find_personal_data(clashing).collect()
    assert len(got) == len(odd_rows)
    assert all(base(r) == plain("") for r in got)
    assert pii.find_personal_data(no_docs).count() == 0
    assert pii.redact(no_docs).count() == 0
    assert sorted(map(str, pii.redact(clashing).collect())) == sorted(map(str, clashing.collect()))
