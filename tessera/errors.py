"""Problems found in contracts."""

from __future__ import annotations

from dataclasses import dataclass

#: fixed values: the kinds of problem
CODES = (
    "document residency unsupported invalid_rule_id duplicate_rule_id duplicate_expose unknown_column bad_type expose_type_mismatch parse outside_profile "
    "unknown_identifier unknown_field unreadable_column unknown_function no_matching_overload type_mismatch namespace non_deterministic transform_target "
    "duplicate_transform unknown_shape_operator inheritance untranslatable shape_params"
).split()


@dataclass
class Problem:
    code: str
    message: str
    rule: str = ""
    line: int = 0
    help: str = ""

    def __str__(self) -> str:
        where = f"line {self.line}: " if self.line else ""
        rule = f" [{self.rule}]" if self.rule else ""
        return f"{where}{self.code}{rule}: {self.message}" + (f"\n  help: {self.help}" if self.help else "")


class ContractError(Exception):
    """A contract is refused; ``problems`` holds every reason found."""

    def __init__(self, *problems: Problem):
        self.problems = list(problems)
        super().__init__("\n".join(map(str, problems)))


def fail(code: str, message: str, **more) -> ContractError:
    if code not in CODES:
        raise ValueError(code)
    return ContractError(Problem(code, message, **more))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def suggest(word: str, known) -> str:
    """``did you mean`` text for the nearest known word, if near enough."""
    near = min(((distance(word, k), k) for k in known), default=(99, ""))
    return f"did you mean `{near[1]}`?" if near[0] <= max(1, max(len(word), len(near[1])) // 3) else ""
