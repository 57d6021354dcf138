"""The near-duplicate stage of the pipeline links from a similarity of 0.8 on."""
import brute

import corpus_pipeline


def test_pairs_between_80_and_85_percent(docs_of):
    rows, shares = [], []
    # `same` of 300 words from the start on are shared: same - 4 shingles of 296 in each text
    for n, same in enumerate((255, 262, 268, 271, 274, 277, 285)):
        base = [f"p{n}w{k}" for k in range(300)]
        other = base[:same] + [f"q{n}w{k}" for k in range(300 - same)]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
        a, b = (brute.shingles(t) for _, t in rows[-2:])
        shares.append(len(a & b) / len(a | b))
    assert sum(s < 0.8 for s in shares) >= 2 and sum(0.8 <= s < 0.85 for s in shares) >= 3 and max(shares) >= 0.85
    docs = docs_of(rows)
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](docs.sparkSession, docs, "")
    want = [2 * n for n in range(len(shares))] + [2 * n + 1 for n, s in enumerate(shares) if s < 0.8]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)
