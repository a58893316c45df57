"""Plain Python versions of the rules, written for small inputs."""

import random
import re

COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def random_dna(rng, n, bases="ACGT"):
    return "".join(rng.choice(bases) for _ in range(n))


def revcomp(s):
    return "".join(COMP[b] for b in reversed(s))


def step(value, *levels):
    for bound, v in levels:
        if value >= bound:
            return v
    return 0


def direct_repeats(s):
    """start -> (unit, spacer, copies, length): longest unit, then smallest spacer, score >= 10."""
    out, n = {}, len(s)
    for i in range(n - 15):
        hit = None
        for unit in range(min(300, (n - i) // 2), 7, -1):
            for spacer in range(0, 11):
                j = i + unit + spacer
                if j + unit > n or s[j:j + unit] != s[i:i + unit]:
                    continue
                copies, end = 2, j + unit
                if spacer == 0:
                    while s[end:end + unit] == s[i:i + unit]:
                        copies, end = copies + 1, end + unit
                k = 0
                while end + k < n and s[i + k] == s[end + k]:
                    k += 1
                length = end + k - i
                score = max(2, 8 / unit) + min(2.5 * copies, 12) + step(length, (100, 4), (50, 3), (30, 2), (20, 1)) - 0.3 * spacer
                if score >= 10:
                    hit = (unit, spacer, copies, length)
                    break
            if hit:
                break
        if hit:
            out[i + 1] = hit
    return out


def tandem_repeats(s):
    """(start, end, unit length) of the jumping scan over units of 1 to 6."""
    need = {1: 6, 2: 5, 3: 4, 4: 3, 5: 3, 6: 3}
    out, i, n = [], 0, len(s)
    while i <= n - 15:
        size = 0
        for unit in range(1, 7):
            word = s[i:i + unit]
            if word in ("GAA", "TTC", "AAG", "AGG", "GGA", "TCT", "CTC", "CTT") and re.search("GAAGAA|TTCTTC", s[i:i + 50]):
                continue
            k = unit
            while i + k < n and s[i + k] == s[i + k - unit]:
                k += 1
            copies = k // unit
            if copies >= need[unit] and k >= 15:
                weight = {1: 4, 2: 3, 3: 2.5, 4: 2, 5: 1.5, 6: 1}[unit]
                if weight + min(1.5 * copies, 12) + step(k, (100, 3), (50, 2), (30, 1)) >= 10:
                    out.append((i + 1, i + k, unit))
                size = k
                break
        i += size or 1
    return out


def inverted_repeats(s):
    """start -> (arm, spacer) with score >= 2."""
    out, n = {}, len(s)
    for i in range(n - 19):
        for arm in range(min(100, (n - i) // 2), 9, -1):
            for spacer in range(0, 6):
                j = i + arm + spacer
                if j + arm > n or s[j:j + arm] != revcomp(s[i:i + arm]):
                    continue
                total = 2 * arm + spacer
                score = step(arm, (100, 8), (70, 7), (50, 6), (30, 5), (20, 4), (15, 3), (12, 2), (10, 1))
                score += step(total, (60, 2), (40, 1)) - (0 if spacer == 0 else 1 if spacer <= 3 else 2)
                if score >= 2 and i + 1 not in out:
                    out[i + 1] = (arm, spacer)
            if i + 1 in out:
                break
    return out


def mirror_repeats(s):
    """(score, start, end) of every mirror repeat with pure arms."""
    out, n = [], len(s)
    for arm in range(10, min(100, n // 2) + 1):
        for spacer in range(0, 13):
            for i in range(n - 2 * arm - spacer + 1):
                left = s[i:i + arm]
                if s[i + arm + spacer:i + 2 * arm + spacer] != left[::-1]:
                    continue
                pur = sum(c in "AG" for c in left) / arm
                pure, total = max(pur, 1 - pur), 2 * arm + spacer
                score = arm * (1 + 1.5 * pure) - 0.8 * spacer + (total >= 50)
                if pure >= 0.9 and total >= 25 and score >= 25:
                    out.append((round(score, 6), i + 1, i + total))
    return out


def pick(rows, shared):
    """Greedy over (start, end) in the given order."""
    chosen = []
    for s, e in rows:
        clash = (lambda a, b: not (e <= a or s >= b)) if shared else (lambda a, b: not (e < a or s > b))
        if not any(clash(a, b) for a, b in chosen):
            chosen.append((s, e))
    return chosen


def pick_covered(rows, share=0.5):
    used, chosen = set(), []
    for s, e in rows:
        mine = set(range(s, e + 1))
        if len(mine & used) <= share * len(mine):
            chosen.append((s, e))
            used |= mine
    return chosen


def sample_texts(seed=7):
    rng = random.Random(seed)
    arm = random_dna(rng, 22)
    unit = random_dna(rng, 60)
    texts = [random_dna(rng, 150, "AC"), random_dna(rng, 200, "AG"), random_dna(rng, 120)]
    texts.append(random_dna(rng, 20) + arm + "ACG" + revcomp(arm) + random_dna(rng, 15))
    texts.append(unit + "TG" + unit + unit[:20] + random_dna(rng, 10))
    texts.append(random_dna(rng, 9) + "GATTACAC" * 4 + "GATT" + random_dna(rng, 9))
    texts += ["GAA" * 30, "CAG" * 20 + "A" * 30, "AT" * 30, "AGGAAGAGGAAAGG" + "TC" + "GGAAAGGAGAAGGA", "AGG" * 8 + "GAAGAA"]
    return texts
