"""Words without meaning, the same for a seed."""


def words(seed: int, n: int) -> list[str]:
    x, out = seed * 2654435761 + 12345, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        # some words are frequent, most are rare
        out.append(f"w{(x >> 40) % (8 if (x >> 33) % 3 == 0 else 900):03d}x")
    return out
