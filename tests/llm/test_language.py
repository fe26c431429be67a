import random
import zlib

import numpy as np

from pagelore.llm import language
from pagelore.llm.language import Network, op9_language
from tests.llm.fixtures import frame, odd_rows, row


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = Network(3, units=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5), rng.random((6, 5))

    def loss():
        z = net.states(x, "f").astype(np.float64) @ net.p["out"][:4] + net.states(x, "b") @ net.p["out"][4:] + net.p["bias"]
        z = z - z.max(axis=2, keepdims=True)
        chance = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
        return -(w * np.log(chance[:, np.arange(5), y])).sum() / w.sum()

    grad = net.gradients(x, y, w)
    for name in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[name].shape) if not name.startswith("table") else (int(x[2, 1]), 3)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-3


def planted():
    rng, out = random.Random(4), []
    kinds = {"xx": "the and shing on", "yy": "der üb keit schen", "zz": "que ment aux été"}
    for i in range(240):
        lang = rng.choice(sorted(kinds))
        parts = kinds[lang].split()
        out.append(row(500 + i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 3)
    rows = planted()
    fit = lambda docs: language.trained(docs.where("doc_id >= 500"))
    out = op9_language(frame(spark, rows + odd_rows() + [row(2000, "12 34 !!")], ("score", "lang_pred", "place")), fit).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == len(rows) + len(odd_rows()) + 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]) > 0.95
    assert all(r.lang_pred == "und" for r in out if r.doc_id in (1, 2, 3, 2000))
    assert all(0 <= r.score <= 1 for r in out)


def test_filter_and_empty_table(spark):
    docs = frame(spark, [*odd_rows(), row(2000, "12 34 !!")], ("score", "lang_pred"))
    kept = language.in_a_language(docs, language.Model(["en"], Network(1)))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 2000})
    assert op9_language(frame(spark, [])).count() == 0
