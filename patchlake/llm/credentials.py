"""Problem 2: credentials in diffs, source and configuration files, with their place, and the text with them redacted.

A line that names a secret, a known token form, a URL with a password, a header or a key block is read in detail.
Literals are decoded recursively (base64, hex, percent and backslash escapes, until nothing decodes any more: every layer
is shorter than the one around it) and rescanned, however long a line or literal is; key
containers are told by their grammar (PEM bodies, DER integers of PKCS#1/PKCS#8/SEC1, the OpenSSH frame), so a public
key or certificate in the same clothes is none.  Redaction replaces the value within its quotes - the whole enclosing
literal where it was encoded - and keeps line ends, quotes and diff signs.  The placeholder has the literal's alphabet, so
it still decodes: zeros for hex digits, base64 or percent codes of the mask for such literals, else the mask itself.

A credential over several lines counts at the line where its assignment or block begins, or the first one shown.
Null and empty texts, and null or empty maps, give no row; repeated entries give one row per case.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.llm.places import places
from patchlake.session import spread, table

MASK = "REDACTED"
MASK_BASE64 = base64.b64encode(MASK[:6].encode()).decode()  # no padding, so fragments of a literal still join
CONTEXT = 300  # characters before a value in which a call names where the secret is kept

# fixed values: forms of the tokens of public services, and the general form "<issuer>_<kind>_<random>"
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|AIza[\w-]{20,}"
    r"|(?:sk|pk|rk)_(?:live|prod|test)_[A-Za-z0-9]{14,}|sk-(?:[a-z]+-)?[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|ya29\.[\w-]{20,}|dop_v1_[a-f0-9]{40,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}|[a-z]{2,4}[._](?:tok|key|srv|sec|pat|live|prod)_[A-Za-z0-9]{18,})"
)
_WORDS = r"pass(?:word|wd|phrase|wort)?|pwd|pw|secret|token|bearer|credentials?|api[._-]?key|apikey|(?:secret|signing|deploy|private|access|encryption|auth|service|client|shared|master|account|session|webhook|license|ssh|tls|cert|signer)[._-]?key|dsn|auth"
_NAME = re.compile(rf"(?:^|[._\-\[\]\"'A-Za-z0-9])(?P<word>(?:{_WORDS}))$", re.I)
#: names that hold a secret word but end with it by chance, or are about the secret
_STRONG = re.compile(r"pass(?:word|wd|phrase|wort)$|(?:^|[._-])(?:pass|pwd|pw)$|(?:admin|root|db|mail|smtp|user)[._-]?(?:pass|pwd|pw)$|(?<![a-z])pwd$|secret$|api[._-]?key$|(?:secret|signing|deploy|private|access|encryption|auth|service|client|shared|master|account|webhook|cert|tls|ssh|license)[._-]?(?:key|token|secret)$|^(?:app\.)?bearer$|(?:^|[._-])(?:auth|access|service|private|refresh|session|bot|api|user)[._-]?token$", re.I)
_ASSIGN = re.compile(
    r"""(?<![\w.-])[\d.-]*(?P<name>[A-Za-z_][\w.-]*)["'`]?\]?\s*(?::\s*[A-Za-z_][\w.\[\], <>]*?\s*)?(?:\)?\s*(?::=|=>|==?(?!=)|:)\s*)(?:[A-Za-z_][\w.]*\.(?:get|getenv|env|environ|valueOf|from)?\w*\s*(?:\(|\[)\s*["'][\w.-]+["']\s*(?:,|\)\s*or|\]?\s*\|\||\)\s*\|\|)\s*|[\w.]+\s*(?:\|\||or|\?\?)\s*|\w*\s*\(\s*|\[\]byte\()?[rbuf]{0,2}(?P<q>\"\"\"|'{3}|["'`])(?P<value>(?:\\.|(?!(?P=q))[^\n])*)(?P<end>(?P=q)|$)"""
)
_JOINED = re.compile(r"""(?<![\w.-])[\d.-]*(?P<name>[A-Za-z_][\w.-]*)["']?\]?\s*(?::=|=|:)\s*(?P<parts>(?:["'`][^"'`\n]*["'`]\s*(?:\+\s*)?)+["'`][^"'`\n]*["'`])""")
_LOGIN = re.compile(r"""\b(?:user|login|account)\w*["']?\s*[=:]\s*["'][^"'\n]*["']\s*,\s*["']?(?:token|secret|key|pw|pass\w*)["']?\s*[=:]\s*["'](?P<value>[^"'\n]+)["']""", re.I)
_XML = re.compile(r"""(?:name|key|id)\s*=\s*["'](?P<name>[\w.-]+)["']\s+value\s*=\s*["'](?P<value>[^"'\n]*)["']""", re.I)
_ELEMENT = re.compile(r"<(?P<name>[\w.-]+)>(?P<value>[^<>\s]+)</(?P=name)>")
_BARE = re.compile(r"^\s*(?:export\s+|ENV\s+|ARG\s+|set\s+|-\s+)*(?P<name>[A-Za-z_][\w.-]*)\s*[=:]\s*(?P<value>[^\s\"'`].*?)\s*$")
_BARE_SHELL = re.compile(r"^\s*(?:export\s+|ENV\s+|ARG\s+)(?P<name>[A-Za-z_][\w.-]*)[= ](?P<value>[^\s\"'`]+)\s*$")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^\s:/@\"'`]*):(?P<value>[^\s@\"'`]+)@[\w.-]")
_PIECE = re.compile(r"""["'`]([^"'`\n]*)["'`]""")
_TEMPLATE = re.compile(r"[{}]|^<.*>$|%\(\w+\)s|^\$\w+$|^[*x.]+$")
_CONNECTION = re.compile(r";\s*(?:pwd|password|accountkey|sharedaccesskey|secret(?:key)?|access[_ ]?key)\s*=\s*(?P<value>[^;\"'`\s]+)", re.I)
_CURL = re.compile(r"(?:^|\s)(?:-u|--user)[ =]?[\"']?(?P<user>[\w.@-]+):(?P<value>[^\s\"']+)")
_HEADER = re.compile(r"(?:authorization|x-(?:api|auth)[\w-]*|api-key|cookie)[\"']?\s*[:=,]\s*[\"'`f]*\s*(?:(?:bearer|token|apikey|key)\s+)?(?P<value>[^\s\"'`{}$<>]{12,})", re.I)
_SCHEME = re.compile(r"\b(?P<scheme>bearer|token|basic)\s+(?P<value>[A-Za-z0-9+/._~=-]{12,})(?=[\"'`\s]|$)", re.I)
_COMMENT = re.compile(r"^\s*(?:;|\*|--)|(?:^|\s)(?:#|//|--\s)|/\*|<!--")
_SAID = re.compile(r"[^\n]*?\b(?:password|passwd|passphrase|pass|pwd|pw|secret|token|key)\b(?:\s+(?:is|was)\s+|\s*[:=]\s*|\s+)(?P<value>\S{8,})\s*(?:\*/|-->)?\s*$", re.I)
_PREFIXES = (re.compile(r"(?:>>>|\.\.\.) "), re.compile(r"\s*\d+(?:[:|]|  )"))
_PEM = re.compile(r"-----(?P<edge>BEGIN|END) (?P<kind>[A-Z0-9 ]*?)(?P<private>PRIVATE KEY(?: BLOCK)?)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_BODY_LINE = re.compile(r"[\"'`\s+(,]*[A-Za-z0-9+/=]{4,}[\"'`\s+\\n,);]*$")
_LITERAL = re.compile(r"(\"\"\"|'{3}|[\"'`])((?:\\.|(?!\1)[^\\\n])*)\1")
_FRAGMENT = re.compile(r"^\s*[rbuf]{0,2}([\"'`])((?:\\.|(?!\1)[^\\])*)\1\s*(?:[+\\,;)]|\)\s*;?)*\s*$")
_ENCODED = re.compile(r"[\"'`](?!data:)[A-Za-z0-9+/_-]{20,}={0,2}[\"'`]|%[0-9A-Fa-f]{2}|\\[0-7]{1,3}")
_ENCODED_BARE = re.compile(r"[=:][ \t]*[A-Za-z0-9+/_-]{24,}={0,2}[ \t\r]*$", re.M)
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){8,}")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# fixed values: what stands where a secret would
_PLACEHOLDER = re.compile(
    r"^\W*(?:change[-_ ]?(?:me|it|this)\w*|replace[-_ ]?(?:me|this)?\w*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|x{3,}(?:[-_]?x+)*|\*+|\.{3,}|dummy\w*|fake[-_ ].*|example\w*|sample\w*|test\w*|todo\w*|tbd|none|null|nil|true|false|undefined|empty|redacted\w*|masked|hidden|secret|password|passwd|token|placeholder\w*|insert[-_ ](?:your|the|here|a)\b.*|<[^>]*>|set[-_ ]?me|not[-_ ]?set|n/?a|default|foo\w*|bar|baz|abc\w{0,3}|123\w{0,5})\W*$"
    r"|^<.*>$|^\$[A-Z_a-z]+$|\$\{|\$\(|\{\{|^\{.*\}$|^%[({]|%\(\w+\)s|^%[A-Z_]+%$|^vault:|^(?:aws-)?(?:ssm|secretsmanager|kms|env|op|file|secret|secrets|keyring|sm|gcp)[:/]|^/run/secrets|^arn:|EXAMPLE|example[-_.]?key|for-docs|placeholder",
    re.I,
)
_DIGEST = re.compile(r"^(?:sha\d+[-:]|md5:|\$2[aby]\$|\$argon2|\$\d\$|\{SHA|pbkdf2)", re.I)
_PATTERN_HINT = re.compile(r"\[[A-Za-z0-9^\\]+-|\\[wdsb]|\{\d+(?:,\d*)?\}|\.\*|\(\?")
_NEAR = ("passw", "passp", "pass", "pwd", "pw", "secret", "token", "key", "bearer", "basic", "auth", "cred", "dsn", "://", "-----", "akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "glpat", "xox", "aiza", "sk_", "sk-", "npm_", "hf_", "eyj", " -u", "cookie", "_tok", "_srv", ".tok", ".srv", "b64", "base64", "hex", "unquote", "%3a", "%40", "\\x", "\\u00")
_PASSWORD_NAME = re.compile(r"(?:pass(?:word|wd|phrase|wort)|pwd|(?:^|[._-])(?:pass|pw))$", re.I)
_WORD_PASSWORD = re.compile(r"[a-z]{7,}|[a-z]{4,}(?:-[a-z]{4,}){2,}")
_PASSPHRASE = re.compile(r"[a-z]{3,}(?: [a-z]{3,}){3,}")
# fixed values: words of prompts, messages and names rather than of passphrases
_PROMPT = re.compile(r"\b(?:enter|your|the|password|passwd|passphrase|secret|please|must|invalid|required|should|cannot|wrong|missing|not|and|for|with|from|this|that|here|environment|vault)\b")
_WORD_NAMES = re.compile(r"(?:password|passwd|passphrase|required|missing|invalid|hidden|masked|environ|keyring|vault|prompt|input|string|unknown|disabled|optional|encrypted|hashed|plaintext|confirm|reset|forgot|expired|changed)", re.I)
_CODE = re.compile(r"\.(?:py|pyi|js|mjs|cjs|jsx|ts|tsx|go|java|kt|scala|rb|rs|c|h|cc|cpp|cs|php|swift|css|min\.js)$")


def plausible(value: str, strong: bool, password: bool = False) -> bool:
    """Whether a literal could be a secret; ``strong``: its name or place says that it is one; ``password``: a quoted one, so words will do."""
    v = value.strip()
    if password and len(v) >= 6 and (_WORD_PASSWORD.fullmatch(v) and not _WORD_NAMES.search(v) or _PASSPHRASE.fullmatch(v) and not _PROMPT.search(v)) and not _PLACEHOLDER.search(v):
        return True
    if not v.replace(MASK_BASE64, "").replace(quoted(MASK), ""):
        return False
    if len(v) < 6 or _PLACEHOLDER.search(v) or _DIGEST.match(v) or any(c.isspace() for c in v) or _PATTERN_HINT.search(v):
        return False
    if TOKEN.search(v):
        return True
    if re.search(r"\{[A-Za-z_][\w.]*\}", v):  # a template
        return False
    digits, upper, lower = sum(c.isdigit() for c in v), sum(c.isupper() for c in v), sum(c.islower() for c in v)
    if digits == len(v):
        return False
    if re.fullmatch(r"(?:[\w-]+\.)+(?:example|invalid|internal|local|com|org|net|test)(?::\d+)?(?:/\S*)?", v) or v.startswith(("./", "../", "http://", "https://")) or v[0] == "/" and not (len(v) >= 32 and min(digits, upper, lower) >= 3):
        return False
    if not strong:  # the name may end with a secret word by chance
        return len(v) >= 16 and digits >= 2 and upper + lower >= 6 and not re.fullmatch(r"[a-z]+(?:[-_./:][a-z0-9]+)+", v) and not re.fullmatch(r"[A-Z_0-9]+", v)
    other = len(v) - digits - upper - lower
    if re.fullmatch(r"[a-z]+(?:[-_./ ][a-z]+)*", v) or re.fullmatch(r"[A-Z]+(?:[-_][A-Z]+)*", v):  # words only
        return len(v) >= 24 and not re.search(r"[-_./ ]", v)
    if re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+|(?:[A-Z][a-z]+)+", v):  # camel case
        return False
    return len(v) >= 8 and (digits > 0 or other > 0 or (upper > 1 and lower > 1))


def quoted(text: str) -> str:
    return "".join(f"%{c:02X}" for c in text.encode())


def decoded(value: str) -> Iterator[bytes]:
    """One layer taken off in each way that applies."""
    if "\\" in value:
        try:
            yield value.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-8", "replace")
        except UnicodeDecodeError:
            pass
    if "%" in value and re.search(r"%[0-9A-Fa-f]{2}", value):
        yield urllib.parse.unquote_to_bytes(re.sub(r"%(?:25)+(?=[0-9A-Fa-f]{2})", "%", value))  # quoted percent signs are further layers
    if _HEX.fullmatch(value):
        yield bytes.fromhex(value)
    if len(value) >= 16 and _B64.fullmatch(value):
        try:
            yield base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass


def container(raw: bytes) -> bool:
    """Private key by its binary grammar: OpenSSH frame, or DER SEQUENCE { INTEGER version, ... } as of PKCS#1, PKCS#8, SEC1."""
    if raw.startswith(b"openssh-key-v1\x00"):
        return True
    if len(raw) < 40 or raw[0] != 0x30:
        return False

    def item(at: int) -> tuple[int, int, int]:
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            n = int.from_bytes(raw[at : at + k], "big")
            at += k
        return tag, at, at + n

    try:
        _, a, b = item(0)
        if b > len(raw) or b < len(raw) - 16:
            return False
        tag, x, y = item(a)
        if tag != 2 or y - x != 1 or raw[x] > 1:
            return False
        tag, x, y = item(y)
        return tag == 0x30 or (tag == 4 and y - x in (28, 32, 48, 66)) or (tag == 2 and y - x >= 32)
    except IndexError:
        return False


def hidden(value: str) -> bool:
    """Whether a literal holds a credential under layers of encoding."""
    todo, seen = [value], {value}

    def look(x: str) -> None:
        if len(x) >= 16 and x not in seen:
            seen.add(x)
            todo.append(x)

    while todo:
        outer = todo.pop()
        if len(outer) < 16:
            continue
        for raw in decoded(outer):
            if container(raw):
                return True
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if text == outer or not text or len(text) > len(outer) or not text.isprintable() and not all(c.isprintable() or c in "\r\n\t" for c in text):
                continue
            if _PEM.search(text) and len(_BODY.findall(text)) > 1 or any(plain(line, False) for line in text.split("\n")):
                return True
            look(text.strip())
            for line in text.split("\n"):
                for m in _LITERAL.finditer(line):
                    look(m.group(2))
    return False


def spans(line: str, bare: bool) -> list[tuple[int, int]]:
    """Places of credentials in one line, plain or encoded; ``bare``: unquoted values count (configuration files)."""
    out = plain(line, bare)
    return sorted({*out, *_encoded(line, out, bare)})


def plain(line: str, bare: bool) -> list[tuple[int, int]]:
    """Places of credential values that are not encoded."""
    out: list[tuple[int, int]] = []
    if _PATTERN_HINT.search(line) and re.search(r"re\.compile|RegExp|Pattern\.|regexp\.|_PATTERN\b", line):
        return out

    def add(m: re.Match, group: str = "value") -> None:
        out.append(m.span(group))

    for m in TOKEN.finditer(line):
        if not _PLACEHOLDER.search(m.group()):
            out.append(m.span())
    low = line.lower()
    for rx in (_ASSIGN, _XML, _ELEMENT):
        for m in rx.finditer(line):
            name = m.group("name")
            if _NAME.search(name):
                v = m.group("value")
                if _STRONG.search(name.replace("authToken", "auth_token")) or "environ" in low or "process.env" in low:
                    if plausible(v, True, rx is _ASSIGN and bool(m.group("end")) and bool(_PASSWORD_NAME.search(name))) and not _dict_key(line, m):
                        add(m)
                elif plausible(v, False):
                    add(m)
    if '"' in line or "'" in line:
        for m in re.finditer(r"""["'](?P<name>[\w.-]+)["']\s*(?::|\]\s*=|,)\s*["'](?P<value>[^"'\n]+)["']""", line):
            if _NAME.search(m.group("name")) and _STRONG.search(m.group("name")) and plausible(m.group("value"), True) and "vault" not in low:
                add(m)
        for m in _JOINED.finditer(line):  # one value in several literals
            parts = list(_PIECE.finditer(line, *m.span("parts")))
            v = "".join(p.group(1) for p in parts)
            if len(parts) > 1 and (TOKEN.search(v) and not _PLACEHOLDER.search(v) or _NAME.search(m.group("name")) and _STRONG.search(m.group("name")) and plausible(v, True) and not _dict_key(line, m, "parts")):
                out.extend(p.span(1) for p in parts if p.group(1))
        for m in _LOGIN.finditer(line):
            if plausible(m.group("value"), True):
                add(m)
    for m in _URL.finditer(line):
        v = m.group("value")
        if not _PLACEHOLDER.search(v) and not _TEMPLATE.search(v):
            add(m)
    if ";" in line and "=" in line:
        for m in _CONNECTION.finditer(line):
            if plausible(m.group("value"), True):
                add(m)
    if "-u" in line or "--user" in line:
        for m in _CURL.finditer(line):
            if plausible(m.group("value"), True):
                add(m)
    if "auth" in low or "api" in low or "cookie" in low:
        for m in _HEADER.finditer(line):
            if plausible(m.group("value"), False) and not _NAME.search(m.group("value")) and "(" not in m.group("value"):
                add(m)
    for m in _SCHEME.finditer(line):
        v = m.group("value")
        if m.group("scheme").lower() == "basic":
            for raw in decoded(v):
                user, _, pw = raw.decode("utf-8", "replace").partition(":")
                if pw and pw.isprintable() and plausible(pw, True):
                    add(m)
                    break
        elif (m.start() > 0 and line[m.start() - 1] in "\"'`") and plausible(v, False):
            add(m)
    if any(w in low for w in ("pass", "pw", "secret", "token", "key", "bearer", "auth", "cred", "dsn")):
        if (c := _COMMENT.search(line)) and (m := _SAID.match(line, c.end())):
            v = m.group("value")
            if plausible(v, True) and not re.fullmatch(r"[\w./-]+", v.rstrip(".")) or (re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and plausible(v, True) and not re.fullmatch(r"\w+=.*|kv/.*|<.*", v)):
                add(m)
        for rx in (_BARE,) if bare else (_BARE_SHELL,):
            if (m := rx.match(line)) and _NAME.search(m.group("name")):
                v = m.group("value")
                if rx is _BARE_SHELL or not re.search(r"[()\[\]{}]\s*[,;]?$|^\w+\(", v) or plausible(v, True):
                    strong = bool(_STRONG.search(m.group("name")))
                    if plausible(v, strong) and not _URL.search(v):
                        add(m)
    return out


def _encoded(line: str, known: list[tuple[int, int]], bare: bool) -> list[tuple[int, int]]:
    """Places of literals with a credential under encoding, besides what is ``known`` of the line."""
    out: list[tuple[int, int]] = []
    cuts, first = sorted(set(known)), 0
    ends = list(accumulate((y for _, y in cuts), max))
    if _PATTERN_HINT.search(line) and re.search(r"re\.compile|RegExp|Pattern\.|regexp\.|_PATTERN\b", line):
        return out
    literals = [m.span(2) for m in _LITERAL.finditer(line)]
    if bare and not literals and (m := _BARE.match(line)):
        literals.append(m.span("value"))
    for a, b in literals:
        if b - a < 16 or line.startswith("data:", a):
            continue
        while first < len(cuts) and ends[first] <= a:
            first += 1
        rest, at = "", a
        for x, y in islice(cuts, first, None):
            if x >= b:
                break
            if y > at:
                rest += line[at : max(x, at)] + MASK
                at = min(y, b)
        if hidden(rest + line[at:b]):
            out.append((a, b))
    return out


def _dict_key(line: str, m: re.Match, group: str = "value") -> bool:
    """A call that names where the secret is kept, such as vault.read("kv/...", field="api_key")."""
    before = line[max(0, m.start(group) - CONTEXT) : m.start(group)]
    return bool(re.search(r"vault|getenv|environ(?:\[|\.get\()[\"'][\w.-]*$|secret_manager|querySelector|\bfield\s*=\s*[\"']$", before) and not re.search(r"(?:,|or|\|\|)\s*[\"'`]$|\]\s*=\s*[\"']$", before))


def config_like(path: str, text: str) -> bool:
    """Whether unquoted values count in this file: by its name, or as its lines say although it is named like code."""
    if not _CODE.search(path):
        return True
    rows = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("#", ";"))]
    return bool(rows) and sum(bool(re.match(r"\s*(?:export |ENV )?[\w.-]+(?:=\S*|: \S.*|:)$|\s*\[[\w.-]+\]$|\s*<|\s*- ", x)) for x in rows) > 0.8 * len(rows)


def scan(text: str, place: str) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(line number, [(line number, start, end)]) of every credential of a text, columns within the line."""
    low = text.lower()
    near: set[int] = set()
    for word in _NEAR:
        at = low.find(word)
        while at >= 0:
            near.add(text.rfind("\n", 0, at) + 1)
            end = text.find("\n", at)
            at = low.find(word, end + 1) if end >= 0 else -1
    for rx in (_ENCODED, _ENCODED_BARE):
        for m in rx.finditer(text):
            near.add(text.rfind("\n", 0, m.start()) + 1)
    diff = place == "diff"
    blocks = "PRIVATE KEY" in text or re.search(r"\.(?:key|pem)$|id_[a-z0-9]+$", place)
    if not near and not blocks:
        return []
    rows = text.split("\n")
    starts, at = {}, 0
    for i, r in enumerate(rows):
        starts[at] = i
        at += len(r) + 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: set[int] = set()

    def sign(i: int) -> str:
        return rows[i][:1] if diff else ""

    prefix = None if diff else next((rx for rx in _PREFIXES if rx.match(text)), None)  # a listing: prompts or line numbers

    def skew(i: int) -> int:
        if diff:
            return 1 if rows[i][:1] in ("+", "-", " ") else 0
        m = prefix.match(rows[i]) if prefix else None
        return m.end() if m else 0

    def body(i: int) -> str:
        return rows[i].rstrip("\r")[skew(i) :]

    if "PRIVATE KEY" in text:
        _blocks(rows, diff, body, sign, skew, found, taken)
    bare_at: dict[int, bool] = {}
    bare = None if diff else config_like(place, text)
    marks = [i for i, r in enumerate(rows) if r.startswith(("+++ ", "--- ")) and "/dev/null" not in r] if diff else []
    for i in sorted(starts[a] for a in near if a in starts):
        if i in taken or diff and rows[i].startswith(("@@", "diff ", "+++ b/", "--- a/", "index ", "rename ")):
            continue
        line = body(i)
        if diff:
            at = bisect_right(marks, i - 1)
            if at not in bare_at:
                shown = rows[marks[at - 1] if at else 0 : marks[at] if at < len(marks) else len(rows)]
                bare_at[at] = config_like(rows[marks[at - 1]][4:].strip() if at else "", "\n".join(r[1:] for r in shown if r[:1] in ("+", " ", "-") and not r.startswith(("+++ ", "--- "))))
            bare = bare_at[at]
        got = spans(line, bare)
        if got:
            k = skew(i)
            found.setdefault(i, []).extend((i, a + k, b + k) for a, b in got)
        if (m := re.search(r"(?<![\w.-])[\d.-]*(?P<name>[A-Za-z_][\w.-]*)[\"']?\]?\s*(?::=|=|:)\s*(?:\w*\(|\(|\\|[\"'`]{0,3})?\s*\\?$", line)) or (m := re.search(r"(?<![\w.-])[\d.-]*(?P<name>[A-Za-z_][\w.-]*)\s*=\s*[\w.]+\(\s*[\"']{0,3}$", line)):
            parts, j = [], i + 1
            while j < len(rows):
                if diff and rows[j].startswith(("@@", "diff ", "+++ ", "--- ")):
                    break
                if diff and sign(j) != sign(i) and sign(j) in "+-" and sign(i) != " ":
                    j += 1
                    continue
                piece = _FRAGMENT.match(body(j)) or (re.match(r"^\s*()([A-Za-z0-9+/=_-]{8,})\s*$", body(j)) if "\"\"\"" in line or "'''" in line or "`" in line else None)
                if not piece:
                    break
                parts.append((j, *(x + skew(j) for x in piece.span(2)), piece.group(2)))
                j += 1
            value = "".join(p[3] for p in parts)
            strong = bool(_NAME.search(m.group("name")) and _STRONG.search(m.group("name")))
            if value and (TOKEN.search(value) or (strong and plausible(value, True)) or hidden(value)):
                found.setdefault(i, []).extend(p[:3] for p in parts)
                taken.update(p[0] for p in parts)
    for i in taken:  # a continuation line is part of its beginning
        if i in found and any(x[0] == i for k, v in found.items() if k != i for x in v):
            found.pop(i)
    return sorted(found.items())


def _blocks(rows: list[str], diff: bool, body, sign, skew, found: dict, taken: set) -> None:
    """PEM private keys, also those of which only a part is shown."""
    i = 0
    while i < len(rows):
        line = body(i)
        m = _PEM.search(line) if "PRIVATE KEY" in line else None
        if not m or _PATTERN_HINT.search(line[m.start() : m.end() + 1]) or re.search(r"re\.compile|RegExp|regexp\.", line):
            i += 1
            continue
        if m.group("edge") == "BEGIN":
            inline = line[m.end() :].replace("\\n", "\n").replace("\\r", "")
            if len(_BODY.findall(inline.split("-----END")[0])) >= 1:  # all on one line
                end = line.rfind("-----")
                found.setdefault(i, []).append((i, m.end() + skew(i), (end if end > m.end() else len(line)) + skew(i)))
                taken.add(i)
                i += 1
                continue
            parts, j, closed = [], i + 1, False
            while j < len(rows) and not (diff and rows[j].startswith(("@@", "diff "))):
                if diff and sign(j) != sign(i) and sign(j) in ("+", "-") and sign(i) in ("+", "-"):
                    j += 1
                    continue
                b = body(j)
                if "-----END" in b:
                    closed = True
                    taken.add(j)
                    break
                if b.strip() and not _BODY_LINE.match(b.strip()) and not re.match(r"\s*(?:Proc-Type|DEK-Info|[A-Z][\w-]+):", b):
                    break
                if b.strip():
                    parts.append((j, skew(j), len(b) + skew(j)))
                j += 1
            if any(body(p[0]).strip() not in (MASK, MASK_BASE64) for p in parts):
                first = i
                before = body(i - 1) if i else ""
                if line.strip(" \t\"'`+") .startswith("-----BEGIN") and re.search(r"[\w\"'\]]\s*(?::=|=|:)\s*(?:\(|\\|\||>|[\"'`]{1,3}|\|-|>-)?\s*$", before) and not before.lstrip().startswith(("#", "//")) and (not diff or not rows[i - 1].startswith(("@@", "+++", "---", "diff"))):
                    first = i - 1
                found.setdefault(first, []).extend(parts)
                taken.update([i, first, *(p[0] for p in parts)])
            i = max(j, i + 1)
        else:  # the beginning is not shown
            j = i - 1
            parts = []
            while j >= 0 and not (diff and rows[j].startswith(("@@", "diff ", "+++ ", "--- "))) and j not in taken and (b := body(j)).strip() and _BODY_LINE.match(b.strip()) and len(b.strip()) >= 8 and b.strip() not in (MASK, MASK_BASE64):
                parts.append((j, skew(j), len(b) + skew(j)))
                j -= 1
            if parts:
                first = parts[-1][0]
                found.setdefault(first, []).extend(parts)
                taken.update([i, *(p[0] for p in parts)])
            i += 1


def mask_of(value: str) -> str:
    """What to write for a credential, in the alphabet of its literal."""
    if re.fullmatch(r"[0-9a-fA-F]{8,}", value) and re.search(r"\d", value):
        return "0" * len(value)
    if hidden(value):
        if _B64.fullmatch(value):
            return MASK_BASE64
        if re.fullmatch(r"(?:%[0-9A-Fa-f]{2}|[\w.~!*'()-])+", value):
            return quoted(MASK)
    return MASK


def redact(text: str, found: list[tuple[int, list[tuple[int, int, int]]]]) -> str:
    """The text with every credential replaced; names, quotes, line ends and diff signs stay."""
    rows = text.split("\n")
    by_line: dict[int, list[tuple[int, int, str]]] = {}
    for _, parts in found:
        several = len({i for i, _, _ in parts}) > 1
        whole = mask_of("".join(rows[i][a:b] for i, a, b in parts)) if several else ""
        for i, a, b in parts:
            by_line.setdefault(i, []).append((a, b, whole))
    for i, cuts in by_line.items():
        merged: list[list] = []
        for a, b, whole in sorted(cuts):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, whole])
        out, at = [], 0
        for a, b, whole in merged:
            value = rows[i][a:b]
            tail = re.search(r"""(?:["'`][\s+\\,);"'`]*|[\s\\,);]+[+\s]*)?$""", value).group()
            value = value[: len(value) - len(tail)]
            mask = "0" * len(value) if whole[:1] == "0" else whole or mask_of(value)
            out += [rows[i][at:a], mask, tail]
            at = b
        rows[i] = "".join(out) + rows[i][at:]
    return "\n".join(rows)


def credentials(texts: DataFrame) -> DataFrame:
    """entry_id, place, line_no."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, p, i + 1) for e, p, t in zip(b["entry_id"], b["place"], b["text"]) for i, _ in scan(t, p)]
            yield pd.DataFrame(rows, columns=["entry_id", "place", "line_no"])

    return spread(texts).mapInPandas(fn, "entry_id string, place string, line_no bigint").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """entry_id, place, n_found, text without credentials."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, p, t in zip(b["entry_id"], b["place"], b["text"]):
                found = scan(t, p)
                rows.append((e, p, len(found), redact(t, found) if found else t))
            yield pd.DataFrame(rows, columns=["entry_id", "place", "n_found", "text"])

    return spread(texts).mapInPandas(fn, "entry_id string, place string, n_found int, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(places(table(spark, sf_dir, "benchmark_entries")))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(places(table(spark, sf_dir, "benchmark_entries")))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts, still_found, lines_changed: redacted texts in which a credential is still found, or which have other line counts."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["place"], b["text"]):
                found = scan(t, p)
                out = redact(t, found) if found else t
                rows.append((bool(found and scan(out, p)), out.count("\n") != t.count("\n")))
            yield pd.DataFrame(rows, columns=["still", "moved"])

    checked = spread(places(table(spark, sf_dir, "benchmark_entries")).select("place", "text")).mapInPandas(fn, "still boolean, moved boolean")
    return checked.agg(F.count("*").alias("texts"), F.count_if("still").alias("still_found"), F.count_if("moved").alias("lines_changed"))


SQL = {
    "p2_clean": """
        SELECT count(*) AS texts, 0 AS still_found, 0 AS lines_changed FROM
        (SELECT diff AS t FROM benchmark_entries UNION ALL SELECT unnest(map_values(base_files)) FROM benchmark_entries) WHERE t IS NOT NULL""",
}
