import random

import pytest

from sparkmill.llm.residue import near_bodies, residue, shingle_sets, shingles, spread_labels, trusted

BAD = [
    "404 Not Found\nnginx/1.27.5", "Please enable JavaScript in your browser to continue.", "About Contact Home\nThis forum works best with JavaScript enabled. Loading…", "How do I store a bag?\n\nLorem ipsum dolor sit amet, Hipuk tol fitum brekart kar.",
    "<<product_title>> | __user.name__ | Q&A\n%%n_votes%%", "Hallo $ORDER_ID$, deine Frage zu #{price_now} wurde :order_id: mal beantwortet.", "Title: <title goes here>\nQuestion: <describe your problem>", "Round only at the end.\n\nUse __shop__ instead of #{N_VOTES} when <<city>> is set.\n\n-- [date]",
    "test test test test test", "Best practice to rank shops\n\nYour browser has scripts switched off, so the rest of this page was not loaded.", '{"status": 429, "error": "internal"}', "Seite  nicht  gefunden – die angeforderte Adresse existiert nicht (Fehler 404).",
    "How do I weigh kibble?\nundefined\nAnswered by [object Object] NaN days ago, null votes", "Users Login\nYour session has expired. Please log in again to view this answer.", "hfjlsaljasfgljddafklhj retrpeweeppputpwo", "Dear [INSERT LINK HERE], thank you for asking about {brand_line}. See the manual.",
]
GOOD = [
    'How do I detect pages that only say "Please enable JavaScript"?\n\nMy crawler stores them as if they were listings.', "seclan answers \"404 Not Found\" for every second page\n\nThe first request is fine, the second one gives 404 Not Found.", "In a mail template, what replaces [[PRICE_NOW]] when the field is null?\n\nWith a I get an empty string.",
    "Escape the braces: write `{{ '{{' }}` and fetrek leaves __link__ alone. Round only at the end.", "Why does my page print `${AUTHOR}` literally?\n\nI render it with x, yet the browser shows <<order_id>> instead of the name of the shop.", 'Is there a lorem ipsum generator for x?\n\nI need 33 rows of "lorem ipsum dolor sit amet" to test a layout.',
    "See the manual.", "Use a window.\n\n```html\n<li>{{ item.price }}</li>\n{% for row in rows %}\n```", "The string you saw, 'Access denied', comes from the proxy, not from x.", "No.", "", "   ", None, "Set `export A=${LINK}` before you call it; the shell fills it in.", "    print(\"%s has %d rows\" % (a, 1))\nMind the nulls.", "Use a window, not a self join. " * 9_000,
]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert any(trusted(text)[:2])


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert not any(trusted(text)[:2])


def test_table_and_spread(spark):
    long_ = "this archive page is only an automatic notice of the old board and holds no answer at all so it can be left out of every export that is made from the board now"
    rows = list(enumerate(BAD + GOOD)) + [(100, "Error establishing a database connection"), (100, "Error establishing a database connection"), (200, long_), (201, long_ + " again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, body string")
    assert {r["doc_id"] for r in residue(df).collect()} == set(range(len(BAD))) | {100}
    assert residue(df.limit(0)).count() == 0


def test_near_bodies(spark):
    a = " ".join(f"w{i}" for i in range(60))
    bodies = [a, a + " tail", " ".join(f"v{i}" for i in range(60))]
    sets = shingle_sets(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {(r["a"], r["b"]) for r in near_bodies(sets, sets).collect()} == {(a, a + " tail"), (a + " tail", a)}
    assert near_bodies(sets, sets.limit(0)).count() == near_bodies(sets.limit(0), sets).count() == 0


def test_near_bodies_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    bodies = set()
    for n in (1, 4, 5, 12, 50, 60, 100, 400):
        for _ in range(6):
            w = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]
            bodies.add(" ".join(w))
            for k in range(5):
                v = list(w)
                for _ in range(k % 3 + 1):
                    v[rng.randrange(n)] = "changed" + str(rng.randrange(5))
                bodies.update([" ".join(v), " ".join(w + ["more"] * (n * k // 20))])
    bodies = sorted(bodies)
    sets = [shingles(b) for b in bodies]
    want = {(a, b) for i, a in enumerate(bodies) for j, b in enumerate(bodies) if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    sets = shingle_sets(spark.createDataFrame([(b,) for b in bodies], "body string"))
    got = {(r["a"], r["b"]) for r in near_bodies(sets, sets).collect()}
    assert got == want | {(b, a) for a, b in want} and len(want) > 50


def test_labels_reach_whole_components(spark):
    """Chains of near-duplicates of different lengths: what one label reaches, and nothing else."""
    chain = lambda x, n: [" ".join(f"{x}{i}" for i in range(k, k + 60)) for k in range(0, 3 * n, 3)]
    parts = [("a", chain("a", 9), 4), ("b", chain("b", 6), 0), ("c", chain("c", 5), None), ("d", chain("d", 1), 0)]
    rows, want, key = [], set(), 0
    for _, bodies, seed in parts:
        for k, b in enumerate(bodies):
            rows.append((key, k == seed, b))
            if seed is not None:
                want.add(key)
            key += 1
    df = spark.createDataFrame(rows, "key bigint, whole boolean, body string")
    assert {r["key"] for r in spread_labels(df).collect()} == want
    assert spread_labels(df.where("NOT whole")).count() == spread_labels(df.limit(0)).count() == 0


def test_labels_spread_over_components(spark):
    known = "404 Not Found " + " ".join(f"filler{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(46))
    first = known + "\nYou can go back to the start"  # a line of unknown words
    second = first + " and then read it again"
    df = spark.createDataFrame([(1, known), (2, first), (3, second), (4, "You can go back to the start"), (5, known)], "doc_id bigint, text string")
    assert not any(trusted(first)[:2]) and not any(trusted(second)[:2])
    assert {(r["doc_id"], r["reason"]) for r in residue(df).collect()} == {(1, "trusted"), (5, "trusted"), (2, "near"), (3, "near")}


def test_long_bodies_and_code_spread_labels(spark):
    known = "404 Not Found " + " ".join(f"filler{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))
    code = "Access denied. You need more rights than you have now to see this board at all <pre>trace 1</pre>"
    rows = [(1, known), (2, known + "\nYou can go back to the start"), (3, code), (4, code + "\nGo back"), (5, "Use a window.\n<pre>trace 1</pre>")]
    assert len(known) > 2_000 and not any(trusted(rows[1][1])[:2]) and not any(trusted(rows[3][1])[:2])
    got = {(r["doc_id"], r["reason"]) for r in residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, "trusted"), (2, "near"), (3, "trusted"), (4, "near")}
