"""Plain versions of operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter


def repeated_bytes(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per text: maximal runs of bytes covered by a string of length bytes that starts anywhere else too."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs, start = [], None
        for i, c in enumerate(covered):
            if c and start is None:
                start = i
            elif not c and start is not None:
                runs.append((start, i))
                start = None
        out.append(runs)
    return out


def best_fit(counts: dict[int, int], window: int) -> list[int]:
    """Room left in each window after best-fit decreasing, sorted."""
    room: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room[room.index(min(fits))] -= length
            else:
                room.append(window - length)
    return sorted(room)


def base_secrets(text: str) -> str:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def quality_counts(text: str) -> tuple[int, int, int, int, int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingle_components(docs: list[tuple[int, str | None]], percent: int, n: int = 3) -> list[tuple[int, int, int]]:
    """(doc_id, size of its set of n-word shingles, smallest id reachable by links)."""
    sets = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()})
    root = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(docs[i][0]), find(docs[j][0])))
                root[y] = x
    return [(d, len(s), find(d)) for (d, _), s in zip(docs, sets, strict=True)]


def links(vectors: list, labels: list, least: float) -> tuple[list[int], list[int]]:
    """(number of links, first row reachable) of each row, by all pairs."""
    import math

    n = len(vectors)
    ok = [v is not None and lb is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, lb in zip(vectors, labels, strict=True)]
    root, count = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                dot = math.fsum(x * y for x, y in zip(vectors[i], vectors[j], strict=True))
                if dot >= least * math.hypot(*vectors[i]) * math.hypot(*vectors[j]):
                    count[i] += 1
                    count[j] += 1
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
    return count, root


def attention_score(model: dict, passages: list[list[float]]) -> float:
    """Gated attention over the passages of one text, number by number."""
    import math

    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    hidden, logits = [], []
    for x in passages:
        h = [max(0.0, sum(x[i] * model["E"][i][j] for i in range(len(x)) if x[i]) + model["e"][j]) for j in range(len(model["e"]))]
        a = 0.0
        for j in range(len(model["w"])):
            t = math.tanh(sum(h[i] * model["V"][i][j] for i in range(len(h))))
            g = sigmoid(sum(h[i] * model["U"][i][j] for i in range(len(h))))
            a += model["w"][j] * t * g
        hidden.append(h)
        logits.append(a)
    weights = [math.exp(a - max(logits)) for a in logits]
    total = sum(weights)
    z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / total for j in range(len(hidden[0]))]
    return sigmoid(sum(z[j] * model["c"][j] for j in range(len(z))) + model["b"][0])
