"""Functions of a page description as columns: sampled, exponential, stitched and calculator programs.

Programs are compiled on the driver into one expression, so they run within generated code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.geometry import let

Interval = tuple[float, float]


def clip(x: Column, bounds: Interval) -> Column:
    return F.least(F.greatest(x, F.lit(float(bounds[0]))), F.lit(float(bounds[1])))


def lerp(x: Column, source: Interval, target: Interval) -> Column:
    """x from one interval to another; an empty source gives the target's start."""
    a, b = source
    if a == b:
        return F.lit(float(target[0]))
    return F.lit(float(target[0])) + (x - a) * (float(target[1] - target[0]) / (b - a))


def sampled(x: Column, samples: Column | Sequence[float], bits: int, domain: Interval = (0, 1), encode: Interval | None = None, decode: Interval = (0, 1), count: int | None = None) -> Column:
    """Type 0 with one input: linear between samples, each of which counts 2**bits - 1 as decode's end."""
    table = samples if isinstance(samples, Column) else F.array(*[F.lit(float(s)) for s in samples])
    n = count if count is not None else len(samples)  # type: ignore[arg-type]
    at = clip(lerp(clip(x, domain), domain, encode or (0, n - 1)), (0, n - 1))

    def value(p: Column, t: Column) -> Column:
        low = F.least(F.floor(p), F.lit(max(n - 2, 0))).cast("int")
        a, b = F.element_at(t, low + 1), F.element_at(t, F.least(low + 2, F.lit(n)))
        return lerp(a + (b - a) * (p - low), (0, 2**bits - 1), decode)

    return let(value, at, table)


def exponential(x: Column, c0: Sequence[float], c1: Sequence[float], n: float, domain: Interval = (0, 1)) -> list[Column]:
    """Type 2: one column an output."""
    p = F.pow(clip(x, domain), F.lit(float(n)))
    return [F.lit(float(a)) + p * float(b - a) for a, b in zip(c0, c1)]


def stitched(x: Column, parts: Sequence, bounds: Sequence[float], encode: Sequence[Interval], domain: Interval = (0, 1)) -> Column:
    """Type 3: parts are functions of a column; each covers its stretch of the domain, mapped to its interval."""
    v, edges = clip(x, domain), [domain[0], *bounds, domain[1]]
    out = None
    for k in range(len(parts) - 1, -1, -1):
        here = parts[k](lerp(v, (edges[k], edges[k + 1]), encode[k]))
        out = here if out is None else F.when(v < bounds[k], here).otherwise(out)
    return out


TOKEN = re.compile(r"[{}]|[^\s{}]+")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


class ProgramError(ValueError):
    """A calculator program that can't be compiled."""


def parse(source: str) -> list:
    """A program as nested lists of tokens."""
    stack: list[list] = [[]]
    for t in TOKEN.findall(re.sub(r"%[^\r\n]*", "", source)):
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) == 1:
                raise ProgramError("a brace too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise ProgramError("a program is one block in braces")
    return stack[0][0]


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _int(x) -> Column:
    return _num(x).cast("long")


def _bool(x: Column) -> Column:
    """Truth as a number: true is -1, all bits set."""
    return F.when(x, F.lit(-1.0)).otherwise(F.lit(0.0))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.abs(b) * 1e-5


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


ONE = {
    "abs": F.abs, "neg": lambda x: -x, "ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"), "truncate": _trunc, "cvi": _trunc, "cvr": lambda x: x,
    "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "ln": F.ln, "log": F.log10, "not": lambda x: (-1 - _int(x)).cast("double"),
}
TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide, "exp": F.pow, "idiv": lambda a, b: _trunc(F.try_divide(_trunc(a), _trunc(b))), "mod": lambda a, b: F.when(_trunc(b) != 0, F.try_mod(_trunc(a), _trunc(b))),
    "and": lambda a, b: _int(a).bitwiseAND(_int(b)).cast("double"), "or": lambda a, b: _int(a).bitwiseOR(_int(b)).cast("double"), "xor": lambda a, b: _int(a).bitwiseXOR(_int(b)).cast("double"),
    "eq": lambda a, b: _bool(_close(a, b)), "ne": lambda a, b: _bool(~_close(a, b)), "gt": lambda a, b: _bool((a > b) & ~_close(a, b)), "lt": lambda a, b: _bool((a < b) & ~_close(a, b)), "ge": lambda a, b: _bool((a > b) | _close(a, b)), "le": lambda a, b: _bool((a < b) | _close(a, b)),
    "bitshift": lambda a, n: F.floor(_trunc(a) * F.pow(F.lit(2.0), n)).cast("double"),
}


def _constant(x, what: str) -> int:
    if isinstance(x, Column):
        raise ProgramError(f"{what} needs a constant")
    return int(x)


def run(block: list, stack: list, degrees: bool = True) -> list:
    """The stack after a block; operands are columns or constants."""
    stack = list(stack)

    def pop():
        if not stack:
            raise ProgramError("the stack is empty")
        return stack.pop()

    for i, t in enumerate(block):
        if isinstance(t, list):
            if i + 1 < len(block) and (block[i + 1] == "if" or isinstance(block[i + 1], list)) or i and isinstance(block[i - 1], list):
                continue
            raise ProgramError("a block that nothing uses")
        if NUMBER.match(t):
            stack.append(float(t))
        elif t in ("true", "false"):
            stack.append(-1.0 if t == "true" else 0.0)
        elif t in ONE:
            stack.append(ONE[t](_num(pop())))
        elif t in ("sin", "cos"):
            x = _num(pop())
            x = F.radians(x) if degrees else x
            stack.append(F.sin(x) if t == "sin" else F.cos(x))
        elif t == "atan":
            b, a = _num(pop()), _num(pop())
            angle = F.atan2(a, b)
            stack.append(F.when(angle < 0, F.degrees(angle) + 360).otherwise(F.degrees(angle)) if degrees else angle)
        elif t in TWO:
            b, a = _num(pop()), _num(pop())
            stack.append(TWO[t](a, b))
        elif t == "pop":
            pop()
        elif t == "exch":
            b, a = pop(), pop()
            stack += [b, a]
        elif t == "dup":
            stack.append(stack[-1] if stack else pop())
        elif t == "copy":
            n = _constant(pop(), t)
            if not 0 <= n <= len(stack):
                raise ProgramError("copy of more than there is")
            stack += stack[len(stack) - n :]
        elif t == "index":
            n = _constant(pop(), t)
            if not 0 <= n < len(stack):
                raise ProgramError("index beyond the stack")
            stack.append(stack[-1 - n])
        elif t == "roll":
            j, n = _constant(pop(), t), _constant(pop(), t)
            if not 0 <= n <= len(stack):
                raise ProgramError("roll of more than there is")
            if n:
                top = stack[len(stack) - n :]
                stack[len(stack) - n :] = top[-j % n :] + top[: -j % n]
        elif t in ("if", "ifelse"):
            yes = block[i - 1] if t == "if" else block[i - 2]
            no = [] if t == "if" else block[i - 1]
            test = _num(pop()) != 0
            a, b = run(yes, stack, degrees), run(no, stack, degrees)
            if len(a) != len(b):
                raise ProgramError("branches that leave stacks of unequal height")
            stack = [x if x is y else F.when(test, _num(x)).otherwise(_num(y)) for x, y in zip(a, b)]
        else:
            raise ProgramError(f"operator {t}")
    return stack


def calculator(source: str, inputs: Sequence[Column], domain: Sequence[Interval] = (), range_: Sequence[Interval] = (), degrees: bool = True) -> list[Column]:
    """Type 4: the outputs of a program, clipped to range; without a domain inputs are taken as they are."""
    xs = [clip(x.cast("double"), d) for x, d in zip(inputs, domain)] if domain else [x.cast("double") for x in inputs]
    out = [_num(x) for x in run(parse(source), xs, degrees)]
    if not range_:
        return out
    if len(out) < len(range_):
        raise ProgramError("too few results")
    return [clip(x, r) for x, r in zip(out[len(out) - len(range_) :], range_)]


def from_dictionary(f: dict, inputs: Sequence[Column], data: bytes = b"") -> list[Column]:
    """The outputs of a function object: its dictionary by keys without slashes, and its stream's data.
    Sampled functions have one input here; a domain or range whose length is odd is rejected."""
    pairs = lambda k: [tuple(map(float, f[k][i : i + 2])) for i in range(0, len(f.get(k) or ()), 2)]
    for k in ("Domain", "Range"):
        if len(f.get(k) or ()) % 2:
            raise ProgramError(f"{k} of odd length")
    kind, domain, range_ = f.get("FunctionType"), pairs("Domain"), pairs("Range")
    if not domain or len(domain) != len(inputs):
        raise ProgramError("a Domain for each input")
    x = inputs[0].cast("double")
    if kind == 4:
        return calculator(data.decode("latin-1"), inputs, domain, range_)
    if kind == 2:
        out = exponential(x, f.get("C0", [0]), f.get("C1", [1]), f["N"], domain[0])
    elif kind == 3:
        parts = [lambda v, g=g: from_dictionary(g, [v])[0] for g in f["Functions"]]
        out = [stitched(x, parts, f.get("Bounds", []), pairs("Encode"), domain[0])]
    elif kind == 0 and len(inputs) == 1:
        from leafmill.sources.codecs import unpack_pixels

        n, bits = int(f["Size"][0]), int(f["BitsPerSample"])
        m = len(range_)
        line = unpack_pixels(data[: -(-n * m * bits // 8)], n * m, 1, bits)
        if not line.size:
            raise ProgramError("too few samples")
        samples = line.reshape(n, m).T.tolist()
        decode = pairs("Decode") or range_
        encode = pairs("Encode")
        out = [sampled(x, row, bits, domain[0], encode[0] if encode else None, d) for row, d in zip(samples, decode)]
    else:
        raise ProgramError(f"function type {kind} of {len(inputs)} inputs")
    return [clip(y, r) for y, r in zip(out, range_)] if range_ else out
