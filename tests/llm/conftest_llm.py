"""Plain versions of what the operators compute."""

import math
from collections import Counter


def jump(key: int, buckets: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def stupid_backoff(docs, order, backoff):
    def grams(w):
        return Counter(tuple(w[i - k + 1 : i + 1]) for i in range(len(w)) for k in range(1, order + 1) if k <= i + 1)

    total, n = Counter(), sum(len(w) for _, w in docs)
    for _, w in docs:
        total += grams(w)
    out = []
    for doc_id, w in docs:
        own, score, gave = grams(w), 0.0, 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                c = total[g] - own[g]
                if c > 0:
                    below = total[g[:-1]] - own[g[:-1]] if k > 1 else n - len(w)
                    score += math.log10(c / below) + (longest - k) * math.log10(backoff)
                    gave += k < longest
                    break
            else:
                score += math.log10(1 / max(n - len(w), 1)) + longest * math.log10(backoff)
                gave += 1
        out.append((doc_id, len(w), gave, score))
    return out


def bm25_top(docs, queries, top, k1=1.2, b=0.75):
    n = len(docs)
    mean = sum(len(w) for _, w in docs) / n
    df = Counter(t for _, w in docs for t in set(w))
    tfs = [Counter(w) for _, w in docs]
    out = []
    for query_id, w in queries:
        scored = []
        for (doc_id, words), tf in zip(docs, tfs):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / mean)) for t in set(w) if t in tf)
            if s > 0:
                scored.append((-round(s, 6), doc_id is not None, doc_id or 0, doc_id))
        out += [(query_id, rank + 1, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored)[:top])]
    return out
