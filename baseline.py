"""Single-threaded Python loops of the headline queries at $BENCH_SF_DIR; prints one JSON line of seconds.

What a program without an engine would do: tables as lists, standard-library types, one
thread. Reading the Parquet file counts, as it does for the queries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import re
import sys
import time
from collections import Counter, OrderedDict, defaultdict, deque

import pyarrow.parquet as pq

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WORD, BREAK = re.compile(r"\w+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])|(?<=\n)\s*")


def columns(table: str, *names: str) -> list[list]:
    read = pq.read_table(f"{SF_DIR}/{table}.parquet", columns=list(names))
    return [read[n].to_pylist() for n in names]


def tokens(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if not w.isdigit()]


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in BREAK.split(text):
        s = " ".join(part.split())
        if s and out and len(s.split(" ")) < 5:
            out[-1] += " " + s
        elif s:
            out.append(s)
    return out


def chunks(text: str, size: int, overlap: int) -> list[str]:
    done, now, n = [], [], 0
    for s in sentences(text):
        if n + len(s) > size and now:
            done.append(" ".join(now))
            keep, total = [], 0
            for x in reversed(now):
                if keep and total + len(x) > overlap:
                    break
                keep.insert(0, x)
                total += len(x) + 1
            now, n = keep, sum(len(x) + 1 for x in keep)
        now.append(s)
        n += len(s) + 1
    return done + ([" ".join(now)] if now else [])


def bm25(texts: list[list[str]], query: Counter) -> list[float]:
    n, average = len(texts), sum(map(len, texts)) / max(1, len(texts)) or 1
    counts = [Counter(w for w in t if w in query) for t in texts]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((n - d + 0.5) / (d + 0.5) + 1) for w, d in df.items()}
    return [sum(query[w] * idf[w] * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * len(t) / average)) for w, k in c.items()) for t, c in zip(texts, counts, strict=True)]


def queries() -> list[Counter]:
    return [Counter(tokens(" ".join(t.replace("\n", " ").split(" ")[:5]))) for _, t in sorted(zip(*columns("benchmark", "item_id", "text"), strict=True))]


def tokenize():
    ids, texts = columns("documents", "doc_id", "text")
    return [(i, len(w), len(set(w)), hashlib.md5(" ".join(w).encode()).hexdigest()) for i, w in ((i, tokens(t)) for i, t in zip(ids, texts, strict=True))]


def bm25_df():
    df = Counter()
    for t in columns("documents", "text")[0]:
        df.update(set(tokens(t)))
    return df


def bm25_rank():
    ids, texts = columns("documents", "doc_id", "text")
    asked = queries()
    vocab = set().union(*asked)
    words = [tokens(t) for t in texts]
    n, average = len(words), sum(map(len, words)) / len(words)
    postings = defaultdict(list)
    for i, w in zip(ids, words, strict=True):
        for term, k in Counter(x for x in w if x in vocab).items():
            postings[term].append((i, k, len(w)))
    out = []
    for q in asked:
        scores = defaultdict(float)
        for term, times in q.items():
            found = postings[term]
            idf = math.log((n - len(found) + 0.5) / (len(found) + 0.5) + 1)
            for i, k, size in found:
                scores[i] += times * idf * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * size / average))
        out.append(heapq.nsmallest(20, scores, key=lambda i: (-round(scores[i], 4), i)))
    return out


def page_query_topk():
    asked, out = queries(), []
    for i, t in zip(*columns("documents", "doc_id", "text"), strict=True):
        parts = chunks(t, 500, 50)
        scores = bm25([tokens(p) for p in parts], asked[i % len(asked)])
        out += [(i, k, scores[k], parts[k]) for k in heapq.nsmallest(5, range(len(parts)), key=lambda k: (-round(scores[k], 4), k))]
    return out


def rag_context():
    by = defaultdict(list)
    n = len(queries())
    for i, k, score, part in page_query_topk():
        by[i % n].append((-score, i, k, part))
    return [sorted(x)[:15] for x in by.values()]


def chunk_text():
    return [chunks(t, 1000, 200) for t in columns("documents", "text")[0]]


def merge_short_sentences():
    return [sentences(t) for t in columns("documents", "text")[0]]


def rerank_freshness():
    asked, by = queries(), defaultdict(list)
    for i, t in zip(*columns("documents", "doc_id", "text"), strict=True):
        by[i % len(asked)].append((i, tokens(f"{t[:40]} {t[:40]} {t}")))
    out = []
    for k, rows in by.items():
        scores = [round(s, 4) for s in bm25([w for _, w in rows], asked[k])]
        best = max(scores) or 1
        out += [(i, s, round(s / best * 0.85 + 0.15 * 0.5, 4)) for (i, _), s in zip(rows, scores, strict=True)]
    return out


def dedup_results():
    best: dict = {}
    for i, s in zip(*columns("documents", "doc_id", "source"), strict=True):
        key, score = f"https://{s}.example/{i % 50}", (i * 37 % 101) / 10
        if key not in best or (-score, i) < best[key]:
            best[key] = (-score, i)
    return best


def classify_topic():
    from sievework.functions.taxonomy import CATEGORIES

    out = []
    for i, t in zip(*columns("documents", "doc_id", "text"), strict=True):
        low = t.lower()
        scores = [(-sum(w in low for w in words), p, o, n) for o, n, p, words in CATEGORIES]
        out.append((i, sorted(s for s in scores if s[0])[:5]))
    return out


def semantic_dedup():
    kept: list = []
    for v in columns("embeddings", "embedding")[0]:
        norm = math.sqrt(sum(x * x for x in v))
        u = [x / norm for x in v]
        if not any(sum(map(float.__mul__, u, w)) >= 0.35 for w in kept):
            kept.append(u)
    return kept


def vector_topk():
    vecs = columns("embeddings", "embedding")[0]
    return heapq.nlargest(10, (sum(a * b for a, b in zip(vecs[0], v, strict=True)) / math.sqrt(sum(x * x for x in v)) for v in vecs))


def rate_limit():
    passed, out = defaultdict(deque), []
    for ts, i, u in sorted(zip(*columns("events", "ts", "event_id", "user_id"), strict=True)):
        q, t = passed[u], ts.timestamp()
        while q and t - q[0] >= 86400:
            q.popleft()
        ok = len(q) < 2
        if ok:
            q.append(t)
        out.append((i, ok))
    return out


def lru_replay():
    caches, out = defaultdict(OrderedDict), []
    for ts, i, u, k in sorted(zip(*columns("events", "ts", "event_id", "user_id", "event_type"), strict=True)):
        held, t = caches[u], ts.timestamp()
        if i % 2 == 0:
            hit = k in held and t <= held[k]
            if hit:
                held.move_to_end(k)
            else:
                held.pop(k, None)
            out.append((i, hit))
        elif i % 10 == 5:
            out.append((i, held.pop(k, None) is not None))
        else:
            if k not in held and len(held) >= 3:
                held.popitem(last=False)
            held[k] = t + 172800
            held.move_to_end(k)
    return out


def html_clean():
    noise, heads, tags = re.compile(r"(?s)<(script|style|header|footer|nav|aside)[^>]*>.*?</\1>"), re.compile(r"(?s)<h([1-6])[^>]*>\s*(.*?)\s*</h\1>"), re.compile(r"<[^<]+?>")
    out = []
    for x in columns("pages", "html")[0]:
        x = heads.sub(lambda m: f"\n{'#' * int(m[1])} {m[2]}\n", noise.sub("", x))
        out.append("\n".join(line for line in (part.strip() for part in tags.sub("\n", x).split("\n")) if line))
    return out


def chart_box():
    by = defaultdict(list)
    for flag, q in zip(*columns("lineitem", "l_returnflag", "l_quantity"), strict=True):
        by[flag].append(q)
    return {f: (v[0], v[len(v) // 4], v[len(v) // 2], v[3 * len(v) // 4], v[-1]) for f, v in ((f, sorted(v)) for f, v in by.items())}


def op6_chat_format():
    by = defaultdict(list)
    for row in zip(*columns("conversations", "conv_id", "turn", "role", "text"), strict=True):
        by[row[0]].append(row[1:])
    escaped = lambda s: (s or "").replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lsqb;")
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1] or "", r[2] or ""))
        spelled = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out.append((conv, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), sum(len(escaped(t)) for _, _, t in turns)))
    return out


def op8_pii():
    kinds = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")]
    return [(i, [[m.span() for m in p.finditer(t)] for p in kinds]) for i, t in zip(*columns("documents", "doc_id", "text"), strict=True)]


def op13_exact_dedup():
    ids, texts = columns("documents", "doc_id", "text")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    plain = [t.translate(lower) for t in texts]
    groups = defaultdict(list)
    for i, t in zip(ids, plain):
        groups[t].append(i)
    return [(i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, plain)]


LOOPS = [page_query_topk, tokenize, bm25_rank, bm25_df, chunk_text, merge_short_sentences, rerank_freshness, dedup_results, classify_topic, semantic_dedup, vector_topk, rate_limit, lru_replay, html_clean, chart_box, rag_context, op6_chat_format, op8_pii, op13_exact_dedup]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    seconds = {}
    for loop in LOOPS:
        began = time.perf_counter()
        loop()
        seconds[loop.__name__] = round(time.perf_counter() - began, 2)
    print(json.dumps({"metric": "single_thread_seconds", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
