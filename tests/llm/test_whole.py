"""Operators do the whole job: classes of a layout decide, all rows teach, rows without an id stay."""
import pytest

from tidemark.llm import html, lm
from tidemark.llm.scratch import Scratch

WIDE = "<html><body><div class=top><p>Wide layout</p></div>%s</body></html>"
SLIM = "<html><body><section><p>Slim layout</p></section>%s</body></html>"
STORY = "<div class=story><h2>Head %d</h2><div><p>Own text %d, long enough to be most of the page.</p><p>By hand %d</p></div></div><article><p>Teaser %d</p></article>"


@pytest.mark.parametrize("bound", [html.BROADCAST_BYTES, 0])
def test_classes_of_a_layout_decide(spark, monkeypatch, bound):
    """Six of 36 pages share a layout: its text is template though under half of the host. The slot with most text is the
    article, not the element named so; a by-line that merely recurs stays."""
    monkeypatch.setattr(html, "BROADCAST_BYTES", bound)
    rows = [(i, f"http://h.example/{i}", (WIDE if i < 30 else SLIM) % STORY % (i, i, i % 5, i)) for i in range(36)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in (3, 33):
        assert f"Own text {i}, long enough to be most of the page.\n\nBy hand {i % 5}" in found[i]
        assert "layout" not in found[i] and "Teaser" not in found[i]


def test_network_learns_from_every_document_once(spark, monkeypatch):
    """No share and no switch by size: each of 1,000 training documents reaches one shard."""
    reached = spark.sparkContext.accumulator(0)

    def learn(words, weights):
        def run(batches):
            for batch in batches:
                reached.add(batch.num_rows)
                yield from ()

        return run

    monkeypatch.setattr(lm, "_learn", learn)
    docs = spark.createDataFrame([(i if i % 50 else None, f"text number {i} of a thousand" if i % 9 else None) for i in range(1000)], "doc_id bigint, text string")
    lm.fit(docs, Scratch(spark))
    assert reached.value == 1000
