"""The nearest page that isn't a copy, with near copies passed over together, against a scan of all places."""

import random
import time
from collections import Counter

from assay.llm import page_text


def scanned(runs, common, texts, reach, first, end):
    """differenced() by its definition: every place up to reach away, the nearest first and the left one of two."""
    for i in range(first, end):
        page, other = runs[i].rows[0][1], None
        rare = Counter()
        for line, kind, size in zip(page.numbers, page.kinds, page.sizes, strict=True):
            rare[line] += size * (kind != page_text.BOILER and line not in common)
        around = [j for j in range(i - reach, i + reach + 1) if j != i and 0 <= j < len(runs)]
        for j in sorted(around, key=lambda j: (abs(j - i), j)):
            there = runs[j].rows[-1 if j < i else 0][1]
            shared = sum(n for line, n in rare.items() if line in there.numbers)
            if runs[j].number != runs[i].number and not (sum(rare.values()) and 10 * shared >= 9 * sum(rare.values())):
                other = there.numbers
                break
        seen = {runs[j].number for j in (*around, i)}
        for row, page in runs[i].rows:
            gone = page_text.common_lines(page.numbers, other) if other is not None else []
            yield row, [k for k in gone if page.kinds[k] == page_text.PLAIN], other is not None or len(seen) >= texts


def host(rng, size, stories, edits, mixed):
    """Pages of near copies of a few stories, in blocks or mixed, with rows of equal texts and lines of all kinds."""
    told = [[rng.randint(0, 60) for _ in range(rng.randint(0, 14))] for _ in range(stories)]
    out = []
    for i in range(size):
        lines = list(told[rng.randrange(stories) if mixed and rng.random() < 0.4 else i * stories // size])
        for _ in range(rng.randint(0, edits)):
            if lines:
                lines[rng.randrange(len(lines))] = rng.choice([1000 + i, 100 + rng.randint(0, 3)])
        kinds = [rng.choice([page_text.PLAIN] * 3 + [page_text.ARTICLE, page_text.BOILER]) for _ in lines] if mixed else [page_text.PLAIN] * len(lines)
        text = page_text.line_number(repr([x for x, kind in zip(lines, kinds, strict=True) if kind != page_text.BOILER]))
        out.append(page_text.Numbers(lines, kinds, [1 + x % 7 for x in lines], text))
    return out


def test_nearest_pages_are_those_of_a_scan():
    rng = random.Random(5)
    deleted = 0
    for t in range(400):
        pages = host(rng, rng.randint(1, 40), rng.randint(1, 3), rng.randint(0, 2), t % 2 == 1)
        runs, common = page_text.runs_of(pages), page_text.site_lines(pages)
        texts = len({p.text for p in pages}) + rng.randint(0, 1)
        first = rng.randrange(len(runs))
        end = rng.randint(first, len(runs))
        for reach in (1, 4, 5, 8, 32):
            got = list(page_text.differenced(runs, common, texts, reach, first, end))
            assert got == list(scanned(runs, common, texts, reach, first, end))
            deleted += sum(len(gone) for _, gone, _ in got)
    assert deleted > 1000


def seconds_of(size):
    def page(i):
        story = [(f"Story {i * 4 // size}, line {k} {'word ' * 10}", page_text.PLAIN) for k in range(20)]
        return [("Site", page_text.PLAIN), *story, (f"Seen {i} times", page_text.PLAIN)]

    pages, began = [page(i) for i in range(size)], time.process_time()
    got = page_text.main_texts(pages, 4)
    assert all(n == 1 and not text.startswith("Site") for text, n in got)
    return time.process_time() - began


def test_time_follows_the_number_of_near_copies():
    """Four times the copies take some four times as long; 16 times if each were compared with each."""
    assert seconds_of(3200) < 10 * max(seconds_of(800), 0.2)
