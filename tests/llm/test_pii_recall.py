"""Recall of planted identifiers that the base expressions leave out, and their places against a plain version of the whole extraction."""

import random
import re

import pytest

from gridspark.llm import pii

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim".split()
#: A context, a form that the base expressions find, and forms that they don't.
CASES = {
    "phone": (("please call", "during office hours"), "+1 {a} 555-{d}", ("({a}) 555-{d}", "{a}-555-{d}", "{a} 555 {d}", "({a}) 555 {d}")),
    "card": (("card number", "expires soon"), "{luhn}", ("{d} {d} {d} {e}", "{d}-{d}-{d}-{e}")),
    "ip": (("the host", "answers again"), "10.0.{b}.7", ("fe80:0:{d}:1", "1.2.3.{x}")),
    "email": (("write to", "with questions"), "a{d}@mail.example", ("b{d}@localhost",)),
}


def valid_card(rnd):
    head = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if pii._luhn(head + c))


def number(rnd, form):
    return form.format(luhn=valid_card(rnd), a=rnd.randint(200, 999), b=rnd.randint(1, 250), d=rnd.randint(1000, 9999), e=rnd.randint(1000, 9999), x=rnd.randint(300, 999))


def corpus(seed):
    rnd = random.Random(seed)
    filler = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(4, 9)))
    docs, planted = [], []
    for (left, right), known, unseen in CASES.values():
        for _ in range(30):
            docs.append(f"{filler()} {left} {number(rnd, known).strip()} {right} {filler()}")
        for form in unseen:
            for _ in range(25):
                value = number(rnd, form)
                head = f"{filler()} {left} "
                planted.append((len(docs), len(head), len(head) + len(value)))
                docs.append(f"{head}{value} {right} {filler()}")
    clean = len(docs)
    for _ in range(150):
        docs.append(f"{filler()} {rnd.randint(1, 9999)} {filler()} {rnd.randint(100, 999)} {rnd.randint(100, 999)} {rnd.randint(1000, 9999)} {filler()} v{rnd.randint(1, 9)}.2.3.{rnd.randint(300, 999)}")
    return docs, planted, clean


@pytest.fixture(scope="module")
def found(spark):
    docs, planted, clean = corpus(4)
    out = pii.extract(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    return docs, planted, clean, {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["learnt"]) for s in r["all_spans"]] for r in out}


def test_unseen_identifiers_are_found(found):
    _, planted, clean, spans = found
    hit = sum(any(a <= start and b >= end for _, a, b, _ in spans[d]) for d, start, end in planted)
    assert hit >= 0.9 * len(planted), (hit, len(planted))
    assert sum(learnt for d in range(clean, clean + 150) for *_, learnt in spans[d]) == 0


def context(text, lo, hi, a, b):
    """The patterns beside text[a:b], between the matches that end at lo and begin at hi."""
    left = [w for w in re.split(pii.SPACE + "+", text[lo:a].lower()) if w]
    right = [w for w in re.split(pii.SPACE + "+", text[b:hi].lower())[1 : pii.WIDTH + 1] if w]
    return [(0, n, ("l", *left[-n:])) for n in range(1, pii.WIDTH + 1) if len(left) >= n] + [(1, n, ("r", *right[:n])) for n in range(1, pii.WIDTH + 1) if len(right) >= n]


def plain(docs):
    rows, places = [], []
    for d, text in enumerate(docs):
        base = pii.brute(text)
        for kind in pii.KINDS:
            ms = sorted((a, b) for k, a, b in base if k == kind)
            # Contexts of a base match reach to the kind's next match of its expression; these texts hold one a kind.
            for a, b in ms:
                rows += [(kind, text[a:b], 1, side, width, c) for side, width, c in context(text, 0, len(text), a, b)]
        toks = [(m.start(), m.end()) for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", text)]
        free = [(k, t) for k, t in enumerate(toks) if not any(a < t[1] and b > t[0] for _, a, b in base)]
        lo = lambda k: toks[k - 1][1] if k else 0  # noqa: B023, E731
        hi = lambda k: toks[k + 1][0] if k + 1 < len(toks) else len(text)  # noqa: B023, E731
        items = []
        for i, (k, (a, b)) in enumerate(free):
            core = re.match(r"^([^\w(+]*)(.*?)[^\w]*$", text[a:b])
            kind = next((x for x, p in pii.SHAPES.items() if re.search(p, core[2])), pii.NONE)
            items.append((kind, core[2], a + len(core[1]), lo(k), hi(k), a, b))
            for m in range(1, pii.LONGEST):
                part = free[i : i + m + 1]
                if len(part) == m + 1 and all(y[1][0] == x[1][1] + 1 for x, y in zip(part, part[1:], strict=False)):
                    core = re.match(r"^([^\w(+]*)(.*?)[^\w]*$", text[a : part[-1][1][1]])
                    n = len(re.sub("[^0-9]", "", core[2]))
                    kind = next((x for x, (p, least, most) in pii.RUNS.items() if re.search(p, core[2]) and least <= n <= most), None)
                    if kind:
                        items.append((kind, core[2], a + len(core[1]), lo(k), hi(part[-1][0]), a, part[-1][1][1]))
        whole = [(start, start + len(value)) for _, value, start, _, _, a, b in items if (a, b) not in toks]
        items = [x for x in items if not any(a <= x[2] and b >= x[2] + len(x[1]) and b - a > len(x[1]) for a, b in whole)]
        for kind, value, start, left, right, a, b in items:
            beside = context(text, left, right, a, b)
            rows += [(kind, value, 0, side, width, c) for side, width, c in beside]
            if kind != pii.NONE:
                places.append((d, kind, value, start, beside))
    p, agree = pii.brute_score(rows)
    out = {d: set() for d in range(len(docs))}
    for d, kind, value, start, beside in places:
        if (kind, value) in agree and (agree[kind, value] >= 2 or any(p.get((kind, side, width, c), 0) >= pii.HALF for side, width, c in beside)):
            out[d].add((kind, start, start + len(value)))
    return {d: {s for s in v if not any(o[1] <= s[1] and o[2] >= s[2] and o[2] - o[1] > s[2] - s[1] for o in v)} for d, v in out.items()}


def test_places_equal_a_plain_version(found):
    docs, _, _, spans = found
    want = plain(docs)
    for d in range(len(docs)):
        assert {s[:3] for s in spans[d] if s[3]} == want[d], docs[d]
        assert {s[:3] for s in spans[d] if not s[3]} == set(pii.brute(docs[d])), docs[d]
