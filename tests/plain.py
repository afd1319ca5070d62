"""Texts and turtles by plain loops, letter by letter: what the library's are held against."""

import math
import re

from ramify.functions import rng
from ramify.plans.grammar import TURNS

COMMANDS = re.compile(r"[a-js\[\]+\-/]", re.IGNORECASE)
#: Start places by index; programs start at the third unless told otherwise.
STARTS = {1: (1.0, 0.1, 0.1), 2: (0.1, 1.0, 0.0), 3: (0.1, 0.1, 1.0)}


def operands(program: str, at: int) -> tuple[float, float]:
    """The one or two numbers in the brackets behind a command; a minus anywhere in a number negates it."""
    stop = program.find(")", at + 2)
    parts = program[at + 2 : stop if stop >= 0 else len(program)].split(",", 1)
    numbers = []
    for part in parts:
        digits = re.sub(r"[-+(,]", "", part)
        numbers.append(-float(digits) if "-" in part else float(digits))
    return numbers[0], numbers[1] if len(numbers) > 1 else 0.0


def states(program: str, d0: float, start: int = 3) :
    """State rows in order; None is a gap."""
    x, y, z = STARTS[start]
    alpha = beta = dx = dy = dz = 0.0
    diam, length = d0, 1.0
    saved = []
    yield x, y, z, alpha, beta, diam, length, dx, dy, dz
    for found in COMMANDS.finditer(program):
        command = found.group()
        if command == "[":
            saved.append((x, y, z, alpha, beta, diam, length, dx, dy, dz))
        elif command == "]":
            if not saved:
                raise ValueError("a closing bracket without its opening one")
            x, y, z, alpha, beta, diam, length, dx, dy, dz = saved.pop()
            yield None
            yield x, y, z, alpha, beta, diam, length, dx, dy, dz
        elif command in "+-/":
            angle, _ = operands(program, found.start())
            if command == "/":
                beta += angle
            else:
                alpha += angle if command == "+" else -angle
        else:
            if command.islower():
                length, wide = operands(program, found.start())
                size = math.sqrt(x * x + y * y + z * z)
                part = length / size if size else 0.0
                a, b = math.radians(alpha), math.radians(beta)
                down = math.sin(a) * y + math.cos(a) * z
                dx = part * (math.cos(b) * x + math.sin(b) * down)
                dy = part * (math.cos(a) * y - math.sin(a) * z)
                dz = part * (math.cos(b) * down - math.sin(b) * x)
                x, y, z = x + dx, y + dy, z + dz
                diam = wide if wide > 0 else diam
            yield x, y, z, alpha, beta, diam, length, dx, dy, dz


def bifurcation_py(d0: float, k: int, sigma: float, stochastic: bool, z: float) -> dict[str, float]:
    best = d0 / 2 ** (1.0 / k)
    d1 = abs(best + best / sigma * z) if stochastic else best
    d1 = best if d1 >= d0 else d1
    d2 = (d0**k - d1**k) ** (1.0 / k)
    a = d2 / d1
    s = 1 + a**3
    degrees = lambda c: math.degrees(math.acos(max(-1.0, min(1.0, c))))
    return {"d1": d1, "d2": d2, "th1": degrees((s ** (4 / 3) + 1 - a**4) / (2 * s ** (2 / 3))), "th2": degrees((s ** (4 / 3) + a**4 - 1) / (2 * a * a * s ** (2 / 3)))}


class Program:
    """Text programs of one network by rule names: F S D G A B R I. Draws are those of the frontier."""

    def __init__(self, seed, network, k: int = 3, epsilon: float = 10.0, randmarg: float = 3.0, sigma: float = 5.0, stochastic: bool = True):
        self.key, self.k, self.epsilon, self.margin, self.sigma, self.stochastic = (seed, network), k, epsilon, randmarg, sigma, stochastic

    def draw(self, path: str, name: str) -> float:
        return rng.uniform_py(*self.key, path, name)

    def fork(self, path: str, d0: float, name: str) -> dict[str, float]:
        return bifurcation_py(d0, self.k, self.sigma, self.stochastic, rng.normal_py(self.draw(path, name + "a"), self.draw(path, name + "b")))

    def long(self, path: str, d0: float, name: str) -> float:
        low, high = d0 * self.epsilon - self.margin, d0 * self.epsilon + self.margin
        return low + self.draw(path, name) * (high - low)

    def step(self, n: int, path: str, d0: float, name: str, letter: str = "D", parts: int = 5) -> str:
        return f"f({self.long(path, d0, name) / parts},{d0})" if n > 0 else letter

    def stem(self, n: int, path: str, d0: float) -> str:
        if n <= 0:
            return "{S}"
        fork, rho = self.fork(path, d0, "s"), int(self.draw(path, "rho") * 3.0 // 1) - 1
        turns = (fork["th1"] * rho, fork["th2"] * abs(rho))
        widths = [1.0] * 5
        if self.draw(path, "taper") < 0.1:
            widths = sorted(1.0 + 0.5 * self.draw(path, f"g{i}") for i in range(3)) + sorted((1.0 + 0.5 * self.draw(path, f"h{i}") for i in range(2)), reverse=True)
        out = [self.step(n - 1, path, widths[0] * d0, "c0")]
        for i, sign in enumerate(TURNS[self.draw(path, "rule") < 0.5]):
            out += [f"{'+' if sign > 0 else '-'}({turns[i % 2]})", self.step(n - 1, path, widths[i + 1] * d0, f"c{i + 1}")]
        return "{" + "".join(out) + "}"

    def tilt(self, path: str, i: int) -> float:
        return (22.5 + 5.0 * self.draw(path, f"t{i}")) * (int(self.draw(path, f"u{i}") * 3.0 // 1) - 1)

    def rule(self, name: str, n: int, d0: float, path: str = "") -> str:
        """The text of a rule; a rule that is used up is its own letter."""
        if n <= 0:
            return "{S}" if name == "S" else name
        if name == "S":
            return self.stem(n, path, d0)
        if name in "DG":
            return self.step(n, path, d0, "c0", name)
        fork = self.fork(path, d0, "f")
        if name == "F":
            one = f"[+({fork['th1']})/({self.tilt(path, 1)}){self.rule('F', n - 1, fork['d1'], path + '1')}]"
            return self.stem(n - 1, path, d0) + one + f"[-({fork['th2']})/({self.tilt(path, 2)}){self.rule('F', n - 1, fork['d2'], path + '2')}]"
        if name == "A":  # its last bracket stays open
            one = f"[+({fork['th1']}){self.rule('A', n - 1, fork['d1'], path + '1')}]"
            return self.stem(n - 1, path, d0) + one + f"[+({fork['th2']}){self.rule('A', n - 1, fork['d2'], path + '2')}"
        spin = 22.5 + 5.0 * self.draw(path, "t1")
        if name == "B":
            return "".join(self.step(n - 1, path, d0, f"c{i}") for i in range(3)) + f"/({spin})" + self.rule("A", n - 1, d0, path + "1")
        if name == "I":
            return f"f({self.long(path, d0, 'c0') / 3},{d0})+({spin})[{self.rule('R', n - 1, d0, path + '1')}]"
        if name == "R":
            whole = self.long(path, d0, "c3")
            steps = "".join(self.step(n - 1, path, d0, f"c{i}") for i in range(3))
            return f"f({whole / 3}){steps}[{self.rule('B', n - 1, fork['d1'], path + '1')}]f({whole / 2},{fork['d2']}){self.rule('B', n - 1, fork['d2'], path + '2')}"
        raise ValueError(f"no such rule: {name}")
