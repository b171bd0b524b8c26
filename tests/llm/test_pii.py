import random

import numpy as np
import pytest

from reviewloom.llm.pii import corpus, model, operator, train


@pytest.fixture(scope="module")
def tagger():
    return model.Tagger.load(operator.WEIGHTS)


def test_gradients_match_differences():
    m = model.Tagger.fresh(5, 3)
    ids, lengths, y = train.batch_of(corpus.Maker(5), 2, np.random.default_rng(0))
    ids, y, lengths = ids[:, :16], y[:, :16], np.minimum(lengths, 16)
    _, g = train.gradients(m, ids, lengths, y)
    for k in m.w:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = m.w[k][i], 1e-2
        m.w[k][i] = old + eps
        up = train.gradients(m, ids, lengths, y)[0]
        m.w[k][i] = old - eps
        down = train.gradients(m, ids, lengths, y)[0]
        m.w[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 0.02 * abs(g[k][i]) + 0.02


def test_fast_scores_equal_the_plain_ones(tagger):
    ids, lengths, _ = train.batch_of(corpus.Maker(7), 9, np.random.default_rng(0))
    plain, fast = tagger.emissions(ids, lengths, {}), tagger.emissions(ids, lengths)
    for r, n in enumerate(lengths):
        assert np.allclose(plain[r, :n], fast[r, :n], atol=1e-3)


def test_skipping_texts_changes_nothing(tagger):
    ids, lengths, _ = train.batch_of(corpus.Maker(8), 60, np.random.default_rng(0))
    scores = tagger.emissions(ids, lengths)
    some = tagger.has_mention(scores, lengths)
    for y, flag in zip(tagger.viterbi(scores, lengths), some):
        assert bool(y.any()) == bool(flag)


def test_decoding_equals_that_with_pointers(tagger):
    ids, lengths, _ = train.batch_of(corpus.Maker(9), 40, np.random.default_rng(0))
    scores = tagger.emissions(ids, lengths)
    trans, first = tagger.w["trans"] + model.forbidden(), tagger.w["first"].copy()
    first[2::2] = -1e4
    for e, n, y in zip(scores, lengths.tolist(), tagger.viterbi(scores, lengths)):
        now, back = e[0] + first, []
        for s in range(1, n):
            cand = now[:, None] + trans
            back.append(cand.argmax(0))
            now = cand.max(0) + e[s]
        want = [int(now.argmax())]
        for ptr in reversed(back):
            want.append(int(ptr[want[-1]]))
        assert y.tolist() == want[::-1]


def test_texts_tagged_together_equal_texts_alone(tagger):
    made = corpus.Maker(10)
    texts = [made.text()[0] for _ in range(120)] + ["Größe “ok” 日本 – write to anna.berg@example.org", "a" * 900 + " call +49 30 1234567"]
    assert model.tag_texts(tagger, texts, 4000) == [model.tag_texts(tagger, [t])[0] for t in texts]
    for t, codes in zip(texts, model.encode_all(texts)):
        assert codes.tolist() == [model._code(c) for c in t]


def test_held_out_accuracy(tagger):
    for kind, (precision, recall) in train.held_out(tagger, corpus.Maker(4242), 600).items():
        assert precision > 0.95 and recall > 0.93, (kind, precision, recall)


def test_training_learns():
    m = model.Tagger.fresh(8, 1)
    batch = train.batch_of(corpus.Maker(1), 8, np.random.default_rng(0))
    losses = []
    for _ in range(15):
        loss, g = train.gradients(m, *batch)
        losses.append(loss)
        size = np.sqrt(sum((x**2).sum() for x in g.values()))
        for k in m.w:
            m.w[k] -= (0.5 * g[k] / size).astype(np.float32)
    assert losses[-1] < 0.7 * losses[0]


def test_spans_and_tags_round_trip():
    r = random.Random(1)
    for _ in range(50):
        text, spans = corpus.Maker(r.randint(0, 10**6)).text()
        assert model.spans_of(model.tags_of(len(text), spans)) == spans


def test_windows_cover_everything():
    for n in (0, 1, 191, 192, 193, 1000, 5001):
        w = model.windows_of(n)
        covered = np.zeros(n, int)
        for a, z in w:
            covered[a:z] += 1
            assert z - a <= model.WINDOW
        assert (covered > 0).all()


def test_long_text_is_tagged_whole(tagger):
    filler = "The box was sturdy and neat. " * 30
    text = filler + "Write to me at anna.smith@dunham.example. " + filler + "Call me on 07700 900123 after six. " + filler
    got = {(text[a:z], k) for a, z, k in operator.find_all(tagger, [text])[0]}
    assert {("anna.smith@dunham.example", "email"), ("07700 900123", "phone")} <= got


def test_placeholders(tagger):
    text = "Thanks to Mary Wexholt for the help! Serial 5457 5667 5462 on the label."
    spans = operator.find_all(tagger, [text, None, ""])
    assert operator.replaced(text, spans[0]) == "Thanks to [NAME] for the help! Serial 5457 5667 5462 on the label."
    assert spans[1] == spans[2] == [] and operator.replaced(None, []) is None


def test_tidy():
    assert operator.tidy("mailto:a@b.example.", (0, 19, "email")) == (7, 18, "email")
    assert operator.tidy("x 12 y", (2, 4, "phone")) is None
    assert operator.tidy("(020) 7946 0001", (0, 15, "phone")) == (0, 15, "phone")
    assert operator.tidy("no such one", (0, 11, "email")) is None


def test_frames(spark):
    rows = [("r1", "Reach me <anna.smith@dunham.example> please.", "t"), ("r1", "Reach me <anna.smith@dunham.example> please.", "t"), ("r2", None, None), ("r3", "", ""), ("r4", "Très bien… Tel. 020 7946 0123", None)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, pii_type string")
    found = {(r["review_id"], r["pii_type"], r["start_at"]) for r in operator.mentions(df.drop("pii_type"), "review_text", ["review_id"]).collect()}
    assert found == {("r1", "email", 11), ("r4", "phone", 17)}
    out = {r["review_id"]: r["redacted"] for r in operator.redact(df, "review_text").collect()}
    assert out["r1"] == "Reach me <[EMAIL]> please." and out["r2"] is None and out["r3"] == ""
    assert operator.mentions(df.limit(0), "review_text", ["review_id"]).count() == 0


#: Sentences of other wording and other names than the training text has; a mention is {type|text}.
UNSEEN = """After the third complaint {name|Giovanni Esposito} finally rang back and apologised.
We had dinner with {name|Ingrid Svensson} who owns the same kettle.
Installation was done by {name|Marek Nowak} in twenty minutes.
The shop's owner, {name|Priya Raghunathan}, replaced it on the spot.
According to {name|T. Okonkwo} it is a known fault.
My daughter {name|Lena Brandt} uses it every morning.
Complaints go nowhere unless {name|Rachel Adeyemi} reads them.
Forward the receipt to {email|lotte.vanberg@posteo.example} if you still have it.
I only got an automatic reply from {email|noreply-returns@bigshop.example.com} and then silence.
Please send the label again, {email|h.kowalski77@mailbox.test} works better.
Their footer lists {email|hilfe@laden-nord.de} as contact.
The hotline {phone|+44 20 7946 0812} was engaged for an hour.
Text {phone|07700 900421} when the replacement is in stock.
Dial {phone|(212) 555 0147} and ask for returns.
Leave a message on {phone|030 23125 884} please.
The courier wanted {id_number|AB 12 34 56 C} before handing it over.
Why does a toaster warranty need my social security number {id_number|219-09-9999}?
They photocopied my passport {id_number|X12345678} at the counter.
Tax number {id_number|12/345/67890} was printed on the invoice for all to see.
It ended up at {address|48 Wellington Road} two streets away.
Next time use the side door of {address|7 rue des Lilas}.
Our office at {address|Lindenstraße 22} never received it.
The neighbours in {address|131 Harbour Lane} had opened the parcel.
We flew it home from New York without damage.
Bought on 12 March 2025 and it died on 3 April 2025.
Model KX-4410-88 has a better hinge than model KX-4400.
Rated 4.7 out of 5 by 1,204 people.
The Oxford Street branch had none left in stock.
Order 4471-882910 took nine days to arrive.""".split("\n")


def test_wording_that_the_model_never_saw():
    """README gives the figures: names inside a sentence are the weak side."""
    import re

    from reviewloom.llm.pii.model import Tagger
    from reviewloom.llm.pii.operator import WEIGHTS, find_all

    texts, gold = [], []
    for line in UNSEEN:
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
            text += line[at : m.start()]
            spans.add((len(text), m.group(1)))
            text += m.group(2)
            at = m.end()
        texts.append(text + line[at:])
        gold.append(spans)
    found = [{(a, kind) for a, _, kind in spans} for spans in find_all(Tagger.load(WEIGHTS), texts)]
    hit = sum(len(g & f) for g, f in zip(gold, found))
    assert hit >= 0.75 * sum(map(len, gold)) and hit >= 0.8 * sum(map(len, found))
