"""The page query against a plain reader and an LSTM that goes block by block."""

import math
import random
from html.parser import HTMLParser

from tallyspark.llm import html_blocks, html_extract


class PlainReader(HTMLParser):
    """Texts between boundaries of block elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.held, self.skip = [], "", None

    def flush(self):
        text = " ".join(self.held.split())
        if text:
            self.texts.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in html_blocks.BLOCK:
            self.flush()
        elif tag in html_blocks.RAW | html_blocks.SKIPPED:
            self.skip = tag
            self.held += " "
        elif tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if self.skip == tag:
            self.skip = None
        elif not self.skip and tag in html_blocks.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.held += data


def plain_texts(html):
    reader = PlainReader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.texts


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def plain_powers(w, rows):
    """Output of each block from its vector: one cell at a time, in plain numbers."""
    hidden = w["hf"].shape[0]
    states = {}
    for d in "fb":
        xd, hd, cd = w[f"x{d}"].tolist(), w[f"h{d}"].T.tolist(), w[f"c{d}"].tolist()
        state, cell, out = [0.0] * hidden, [0.0] * hidden, [None] * len(rows)
        for t in range(len(rows)) if d == "f" else reversed(range(len(rows))):
            on = [(k, v) for k, v in enumerate(rows[t].tolist()) if v]
            z = [cd[j] + sum(v * xd[k][j] for k, v in on) + sum(s * u for s, u in zip(state, hd[j], strict=True)) for j in range(4 * hidden)]
            for j in range(hidden):
                cell[j] = sigmoid(z[hidden + j]) * cell[j] + sigmoid(z[j]) * math.tanh(z[3 * hidden + j])
            state = [sigmoid(z[2 * hidden + j]) * math.tanh(cell[j]) for j in range(hidden)]
            out[t] = state
        states[d] = out
    o = w["o"][:, 0].tolist()
    return [sum(a * b for a, b in zip(states["f"][t] + states["b"][t], o, strict=True)) + float(w["p"][0]) for t in range(len(rows))]


def test_query_against_plain_reader_and_network(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_extract.trained()
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    for r in pages.orderBy("page_id").limit(20).collect():
        read = html_blocks.blocks(r.html)
        texts = plain_texts(r.html)
        assert [b.text for b in read] == texts
        powers = plain_powers(model.w, html_blocks.vectors(read))
        # no page has a block so near the limit that the order of sums decides
        assert all(abs(p) > 1e-3 for p in powers)
        want = "\n".join(t for t, p in zip(texts, powers, strict=True) if p > 0)
        assert got[r.page_id] == (want, len(want))


def test_reader_on_unseen_layouts():
    rng = random.Random(123)
    for _ in range(150):
        page = html_extract.synthetic_page(rng)
        assert [b.text for b in html_blocks.blocks(page)] == plain_texts(page)
