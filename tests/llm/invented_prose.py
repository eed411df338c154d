import random

WORDS = "the of and river stone winter garden letter silent morning paper window yellow market bridge captain island copper thunder velvet".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ed", ",", "."]) for _ in range(n))
