import random

import numpy as np
import pytest

from tidewrack.llm import residue
from tidewrack.llm.blocks import BlockLabeller, fit_block_labeller, furniture_lines, page_blocks, tag_paths
from tidewrack.llm.furniture import general_furniture, is_furniture, recurrent_lines, visible_lines, weak_labels
from tidewrack.llm.residue import RADIUS, core_text, residue_rows, simhash, table_keys, table_masks, table_plan, template_set
from tidewrack.llm.words import WordHash

REAL = "Two rowers, one veteran, were screened before Monday. The trial was long and slow, and nobody found it dull."
RESIDUE = [
    "404 Not Found\nReference 86aa9ed6-bf63", "Please enable JavaScript to view this page.", "Home · Shop · Jobs\n\nPlease sign in to continue. Your session has expired.", "Dear {{ name }},\nTags: %%topic%%\nBy <<author>>",
    "No <%= product %> in Riga is as ${topic} as the one {{ name }} brought by [city]", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "bla bla bla bla 38", "Seite nicht gefunden\nZur Startseite", "Les scripts sont désactivés : rien ne peut s'afficher.", '{"error": "not_found", "status": 404}',
    "<p>Tags: %%a%%</p><p># *|b|*</p>", "TODO: write intro 6813a550-88ac",
]
FINE = [REAL, f'A page that says "please enable JavaScript" is not an article, Ann argues.\n\n{REAL}', f"Listeners asked what {{{{name}}}} means in our letters. {REAL}", f"Filler such as lorem ipsum has its uses, says Ann. {REAL}", "Ann traced the 404 Not Found replies to a stale cache.", "", "Home | Shop | Jobs", f"{REAL} [...]"]


def _found(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    return {r.rec_id for r in residue_rows([("items", df, "item_id", "text")], **kw).collect()}


def test_residue_and_real_texts(spark):
    texts = RESIDUE + FINE + [None, REAL * 2000, RESIDUE[0]]
    assert _found(spark, texts) == {*range(len(RESIDUE)), len(texts) - 1}
    assert _found(spark, []) == set()
    # without trusted texts only unfilled slots tell, so the other labels came by spreading
    assert _found(spark, texts, trusted=[]) == {i for i, t in enumerate(RESIDUE) if "<<" in t or "<%=" in t or "*|" in t}


@pytest.mark.parametrize("most", [500_000, 0])
def test_labels_spread_over_two_links(spark, monkeypatch, most):
    """Texts without any trusted wording of their own are labelled through a chain of near copies, by either join."""
    monkeypatch.setattr(residue, "BROADCAST_KEYS", most)
    words = "our reader cannot open the entry you wanted because the shelf it stood on was cleared and its number went back into the pool of free numbers for later use by other entries of this collection and its many sister collections all over the network".split()
    near, far = [*words[4:], "meanwhile", "ask", "staff"], [*words[8:], "meanwhile", "ask", "staff", "or", "wait"]
    texts = [" ".join(x) for x in (words, near, far, [*words[25:], *"this one has become quite another text by now and nobody minds at all".split()])]
    assert _found(spark, texts) == set()
    assert _found(spark, texts, trusted=[texts[0]]) == {0, 1, 2}
    assert _found(spark, [texts[0], texts[2], texts[3]], trusted=[texts[0]]) == {0}


def test_tables_find_nine_in_ten_links_of_the_similarity():
    r = np.random.default_rng(3)
    for labelled in (100, 100_000):
        masks = table_masks(*table_plan(labelled))
        for n in (9, 90):
            first, second = [], []
            for _ in range(600):
                x = r.integers(0, 2**63, 2 * n).astype(np.uint64)
                common = n * 8 // 9  # a similarity of 0.8
                first.append(np.unique(x[:n]))
                second.append(np.unique(np.concatenate([x[:common], x[n : 2 * n - common]])))
            a, b = simhash(first), simhash(second)
            unequal = np.unpackbits((a ^ b).view(np.uint8), axis=1).sum(axis=1)
            found = (table_keys(a, masks) == table_keys(b, masks)).any(axis=1) & (unequal <= RADIUS)
            assert found.mean() >= 0.9, (labelled, n, found.mean())


def test_labels_spread_over_links_of_the_similarity(spark):
    """Nothing but what brute force labels, and nine in ten of it, where links lie close above and below the similarity."""
    r = random.Random(11)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    texts = []
    for family in range(40):
        # a trusted text has slots; its copies lose them, then words at the end
        base = r.choices(words, k=92)
        once = base + r.choices(words, k=r.choice([4, 8, 14]))
        far = once[4 + family % 4 :] + r.choices(words, k=4)
        texts += [" ".join(x) for x in (base + ["{{name}}"] + base[:12] + ["{{name}}", "{{a}}"] * 5, once, far, r.choices(words, k=100))]
    hashed = WordHash()
    sets, own = zip(*[template_set(core_text(t), hashed) for t in texts])
    sets = [set(s.tolist()) for s in sets]
    links = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    want = trusted = {i for i, t in enumerate(own) if t}
    while new := {b for a, b in links if a in want} - want:
        want = want | new
    got = _found(spark, texts, trusted=[])
    assert len(trusted) == 40 and len(want) > 60
    assert trusted <= got <= want and len(got - trusted) >= 0.9 * len(want - trusted)


def test_furniture_wording():
    for s in ("Home | Shop | Jobs", "* Über uns", "[Press](/press) [Team](/team)", "© 2023 Quartz Fold. All rights reserved.", "We use cookies to count visitors.", "More: How it ended", "Shop > News > A title", "12 comments · Log in to reply"):
        assert general_furniture(s), s
    assert is_furniture("Made with care in Riga") and not general_furniture("Made with care in Riga")
    assert general_furniture(" | ".join(["Home", "Shop", "Jobs"] * 40)) and weak_labels(["Related posts", "A title " * 40]) == [1, 1]  # of any length
    for s in (REAL, "How it ended", "## Home and garden", "The shop closed at noon."):
        assert not is_furniture(s), s
    assert weak_labels(["A title", "", REAL, "Related posts", "» One", "Two", REAL]) == [0, -1, 0, 1, 1, 1, 0]


def test_visible_lines_and_paths():
    page = "<html><head>\n<style>.a{color:#0c7}</style>\n<script>\nvar p='x';\n</script>\n<title>t</title></head>\n<nav>Home <em>|</em> Shop</nav>\n<p>a &amp; b</p><!-- c\nd --> e"
    assert visible_lines(page) == ["", "", "", "", "", "", "Home | Shop", "a & b", "e"]
    assert tag_paths("<main>\n<p>x</p>\n</main>\ny") == ["main", "main/p", "", ""] and tag_paths("a\nb") == ["text", "text"]


def _page(k):
    return "\n".join(["Home | Shop | Jobs", f"A title {k}", "", f"{REAL} It was number {k}.", "More: another title", f"The end of number {k} came soon.", "Related posts", f"» Title {k + 1}", f"Title {k + 2}", "© 2023 Quartz Fold. All rights reserved."])


def test_labeller_learns_from_context(spark):
    pages = [_page(k) for k in range(200)]
    model = fit_block_labeller(pages[:150])
    hashed, wrong, n = WordHash(), 0, 0
    for t in pages[150:]:
        _, w, p, s, shown = page_blocks(t, hashed)
        y = np.array(weak_labels(shown))
        wrong += int(((model.score([(w, p, s)])[0] > 0) != y).sum())
        n += len(y)
    assert wrong <= 0.02 * n
    df = spark.createDataFrame([(k, t) for k, t in enumerate(pages)] + [(900, None), (901, ""), (902, "\n \n"), (903, REAL + "\n" + "x" * 100_000)], "item_id bigint, text string").selectExpr("item_id", "text", "'clash' as tbl")
    got = furniture_lines([("items", df, "item_id", "text")], 150).collect()
    assert {r.line_no for r in got if r.rec_id == 7} == {1, 5, 7, 8, 9, 10}
    assert not {r.rec_id for r in got} & {900, 901, 902}
    assert furniture_lines([("items", df.limit(0), "item_id", "text")]).count() == 0


def test_labeller_learns_wording_that_no_list_has():
    """A site's own lines are learnt from their recurrence, and found on pages it was not trained on."""
    r = random.Random(2)
    words = [a + b for a in ("mor", "tel", "vas", "rin", "dop", "kel") for b in ("an", "ost", "ire", "ulm", "ek")]
    line = lambda n: " ".join(r.choices(words, k=n)).capitalize() + "."
    own = [["Fernlight keeps the lamps on", "A word from the keepers of Fernlight"], ["Harrow and sons, printers", "Printed matter by Harrow"]]
    pages = [[own[k % 2][0], line(5), line(30), line(25), own[k % 2][1]] for k in range(120)]
    assert not any(general_furniture(s) for p in pages for s in p)
    assert recurrent_lines(pages) == {s for site in own for s in site}
    assert recurrent_lines([["a", "b c"]] * 9) == set()  # versions of one text
    model, hashed = fit_block_labeller(["\n".join(p) for p in pages[:100]]), WordHash()
    for p in pages[100:]:
        _, w, path, shape, _ = page_blocks("\n".join(p), hashed)
        assert [x > 0 for x in model.score([(w, path, shape)])[0]] == [True, False, False, False, True]


def test_gradients():
    """Back-propagation agrees with differences of the loss."""
    hashed = WordHash()
    _, w, p, s, shown = page_blocks(_page(1), hashed)
    page, y = (w, p, s), np.array(weak_labels(shown), np.float32)

    def loss(m):
        z = m.score([page])[0].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    before = BlockLabeller(3)
    start = loss(before)
    before.train([page], [y], epochs=40, batch=1)
    assert loss(before) < 0.1 * start
