"""Two-dimensional facsimile coding (ITU-T T.6): decoder and encoder for bitmaps, as plain functions.

Code tables are packed: four hexadecimal digits a code, whose bits follow a leading one.
"""

from __future__ import annotations

from leafmill.sources.codecs import FilterError

_WHITE = "0135004700170018001b001c001e001f00330034002700280048004300740075006a006b00a7008c008800970083008400a800ab009300a4009801020103011a011b01120113011401150116011701280129012a012b012c012d01040105010a010b01520153015401550124012501580159015a015b014a014b013201330134"
_WHITE_64 = "003b0032005700b701360137016401650168016702cc02cd02d202d302d402d502d602d702d802d902da02db02980299029a0058029b"
_BLACK = "0437000a00070006000b0013001200230045004400840085008701040107021804170418040808670868086c083708280817081810ca10cb10cc10cd10681069106a106b10d210d310d410d510d610d7106c106d10da10db105410551056105710641065105210531024103710381027102810581059102b102c105a10661067"
_BLACK_64 = "040f10c810c9105b103310341035206c206d204a204b204c204d2072207320742075207620772052205320542055205a205b20642065"
_LONG = "0808080c080d101210131014101510161017101c101d101e101f"


def _codes(packed: str) -> list[str]:
    return [f"{int(packed[i : i + 4], 16):b}"[1:] for i in range(0, len(packed), 4)]


def _runs(short: str, long: str) -> dict[str, int]:
    """Code -> run length: 0 to 63, then multiples of 64."""
    out = {c: n for n, c in enumerate(_codes(short))}
    return out | {c: 64 * (n + 1) for n, c in enumerate(_codes(long) + _codes(_LONG))}


RUNS = (_runs(_WHITE, _WHITE_64), _runs(_BLACK, _BLACK_64))
#: Mode codes: a vertical shift, or a word.
MODES = {"1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "0001": "pass", "001": "pair"}
END = "000000000001" * 2


class _Bits:
    def __init__(self, data: bytes):
        self.s = "".join(map("{:08b}".format, data))
        self.at = 0

    def code(self, table: dict, longest: int):
        """The entry of the next code, or None."""
        for n in range(1, longest + 1):
            got = table.get(self.s[self.at : self.at + n])
            if got is not None and self.at + n <= len(self.s):
                self.at += n
                return got
        return None

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[color], 13)
            if n is None:
                raise FilterError(f"no run length at bit {self.at}")
            total += n
            if n < 64:
                return total


def _change(row: list[int], a0: int, color: int) -> int:
    """Index in row of the first change right of a0 to the opposite of color. row: changes in order, the
    first to black; it ends with several times the width."""
    i = color
    while row[i] <= a0 and row[i] < row[-1]:
        i += 2
    return i


def decode(data: bytes, columns: int, align: bool = False, rows: int = 0) -> bytes:
    """Rows of bits, black as 1, padded to bytes. rows: how many there are at most; 0 for all."""
    bits, out = _Bits(data), bytearray()
    above = [columns] * 4
    width = -(-columns // 8)
    while not rows or len(out) < rows * width:
        if bits.s.startswith(END, bits.at) or bits.at >= len(bits.s):
            break
        a0, color, now = -1, 0, []
        while a0 < columns:
            mode = bits.code(MODES, 7)
            i = _change(above, a0, color)
            if mode is None:
                if a0 < 0 and not bits.s[bits.at :].strip("0"):  # padding
                    return bytes(out)
                raise FilterError(f"no mode at bit {bits.at}")
            if mode == "pass":
                a0 = above[i + 1]
            elif mode == "pair":
                first, second = bits.run(color), bits.run(1 - color)
                a0 = max(a0, 0) + first
                now += [a0, a0 + second]
                a0 += second
            else:
                a0 = above[i] + mode
                if a0 < (now[-1] if now else 0):
                    raise FilterError(f"a change before the last at bit {bits.at}")
                now.append(a0)
                color = 1 - color
        if a0 > columns:
            raise FilterError("a row that is too long")
        above = [x for x in now if x < columns] + [columns] * 4
        line = 0
        for k in range(0, len(above) - 1, 2):
            if above[k] >= columns:
                break
            line |= (1 << (columns - above[k])) - (1 << (columns - above[k + 1]))
        out += (line << (width * 8 - columns)).to_bytes(width, "big")
        if align:
            bits.at += -bits.at % 8
    return bytes(out)


_MODE_OF = {v: k for k, v in MODES.items()}
_RUN_OF = tuple({n: c for c, n in t.items()} for t in RUNS)


def _run_code(n: int, color: int) -> str:
    out = ""
    while n >= 2560:
        out, n = out + _RUN_OF[color][2560], n - 2560
    if n >= 64:
        out, n = out + _RUN_OF[color][n // 64 * 64], n % 64
    return out + _RUN_OF[color][n]


def encode(data: bytes, columns: int, align: bool = False) -> bytes:
    """The inverse of decode()."""
    width, above, out = -(-columns // 8), [columns] * 4, ""
    for k in range(0, len(data), width):
        row = "".join(map("{:08b}".format, data[k : k + width]))[:columns]
        now = [i for i in range(columns) if row[i] != (row[i - 1] if i else "0")] + [columns] * 4
        a0, color = -1, 0
        while a0 < columns:
            j = _change(now, a0, color) if a0 >= 0 else 0
            i = _change(above, a0, color)
            if above[i + 1] < now[j]:
                out, a0 = out + _MODE_OF["pass"], above[i + 1]
            elif abs(now[j] - above[i]) <= 3:
                out, a0, color = out + _MODE_OF[now[j] - above[i]], now[j], 1 - color
            else:
                out += _MODE_OF["pair"] + _run_code(now[j] - max(a0, 0), color) + _run_code(now[j + 1] - now[j], 1 - color)
                a0 = now[j + 1]
        above = now
        if align:
            out += "0" * (-len(out) % 8)
    out += END
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big") if out else b""
