"""Re-parameterised questions: templates against a version of plain loops."""

import random
from collections import defaultdict

from loglathe.llm import decontaminate as d


def parts(text):
    """(words, [(first word, how many, is a slot, template or value)]) of a text."""
    words = [x for x in ((*d.canonical(w),) for w in (text or "").split()) if x[2] != d.NONE]
    out, previous = [], None
    for i, (literal, template, kind) in enumerate(words):
        if kind == previous and kind in (d.NAME, d.SPELT_NUMBER):
            at, n, k, t, v = out[-1]
            out[-1] = (at, n + 1, k, t, (*v, literal))
        else:
            out.append((i, 1, kind, template, (literal,)))
        previous = kind
    return [w[0] for w in words], out


def windows(text, short):
    words, of = parts(text)
    part_of = {i: p for p, (at, n, *_) in enumerate(of) for i in range(at, at + n)}
    for width in range(1, d.WIDTH + 1):
        if width == d.WIDTH or not short or len(words) == width:
            for i in range(len(words) - width + 1):
                yield ("literal", width, tuple(words[i : i + width])), part_of[i], range(i, i + width), ()
        if width >= d.LITERAL and (width == d.WIDTH or not short or len(of) == width):
            for i in range(len(of) - width + 1):
                some = of[i : i + width]
                plain = sum(x[2] == d.PLAIN for x in some)
                if width * d.LITERAL // d.WIDTH <= plain < width:
                    slots = tuple((x[3], x[4]) for x in some if x[2] != d.PLAIN)
                    yield ("template", width, tuple(x[3] for x in some)), i, range(some[0][0], some[-1][0] + some[-1][1]), slots


def brute_force(docs, items):
    first = {}
    for i, t in sorted(items.items()):
        first.setdefault(t, i)
    asked = defaultdict(set)
    for t, i in first.items():
        for key, place, _, slots in windows(t, True):
            asked[key].add((i, place, slots))
    out = {}
    for doc, text in docs.items():
        diagonals = defaultdict(lambda: [set(), set(), set()])
        for key, place, covered, slots in windows(text, False):
            for item, at, values in asked.get(key, ()):
                every, literal, pairs = diagonals[item, place - at]
                every.update(covered)
                pairs.update(zip(values, slots, strict=True))
                if key[0] == "literal":
                    literal.update(covered)
        best = defaultdict(tuple)
        for (item, _), (every, literal, pairs) in diagonals.items():
            consistent = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
            best[item] = max(best[item], (len(every if consistent else literal), literal == every))
        out |= {(doc, item): b for item, b in best.items() if b[0]}
    return out


QUESTION = "A train with John Smith aboard leaves Boston at 40 miles per hour and needs seven hours to reach the coast"


def found(docs, spark, texts, items):
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_words, r.exact) for r in d.contaminated(docs(texts.items()), table).collect()}


def test_names_and_numbers_of_any_length(docs, spark):
    texts = {
        1: "Said the teacher: " + QUESTION.replace("John Smith", "Mary").replace("Boston", "New York City").replace("40", "fifty five").replace("seven", "12") + " or so",
        2: QUESTION.replace("John Smith", "Anna Maria Lopez").replace("seven", "twenty-one"),
        3: "Nothing of the kind is told in this text about a train that leaves the city for the coast",
    }
    got = found(docs, spark, texts, {5: QUESTION, 6: "Ann buys three apples and sells two of them to Bob for money"})
    assert set(got) == {(1, 5), (2, 5)} and all(n >= 20 and not exact for n, exact in got.values())
    swapped = {4: "Carl buys eleven apples and sells ten of them to Carl for money", 5: "Mary Ann buys ninety nine apples and sells 2 of them to Jim for money"}
    got = found(docs, spark, swapped, {6: "Ann buys three apples and sells two of them to Bob for money"})
    assert set(got) == {(5, 6)}  # one name can't stand for two


def test_templates_like_plain_loops(docs, spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(12)] + ["Anna", "Bob", "Lee", "Rio", "7", "3.5", "$20", "km", "seven", "forty", "two-hundred", "-", "(x)", "Ünal"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(text(rng.choice([2, 4, 6, 9, 12, 25]))) for i in range(25)} | {90: QUESTION, 91: QUESTION, 92: "", 93: None}

    def changed(words):
        swap = {"Anna": rng.choice(["Eve", "Eve Lou", "Anna"]), "Bob": "Max Von Berg", "7": rng.choice(["8", "nine ten"]), "seven": "12", "km": rng.choice(["km", "miles"])}
        return [swap.get(w, w) for w in words]

    texts = {}
    for i in range(60):
        words = text(rng.randrange(12))
        for _ in range(rng.randrange(3)):
            own = (items[rng.choice(list(items))] or "").split()
            words += (changed(own) if rng.random() < 0.6 else own) + text(rng.randrange(5))
        texts[i] = " ".join(words)
    texts |= {100: None, 101: "", 102: QUESTION.upper(), 103: QUESTION.replace(" ", "\n")}
    want = brute_force(texts, {i: t for i, t in items.items() if t is not None})
    got = found(docs, spark, texts, items)
    assert got == want and len(want) > 40


def test_templates_of_no_rows(docs, spark):
    assert found(docs, spark, {}, {1: QUESTION}) == {} == found(docs, spark, {1: QUESTION}, {})


def test_a_very_long_text(docs, spark):
    filler = " ".join(f"filler{i % 977}" for i in range(200_000))
    assert set(found(docs, spark, {1: f"{filler} {QUESTION} {filler}", 2: filler}, {5: QUESTION})) == {(1, 5)}
