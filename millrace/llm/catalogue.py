"""The query modules of this subpackage."""

from millrace.llm import abuse, heavy, leaks, pairs, privacy, stuffing, tokens

MODULES = (pairs, heavy, tokens, leaks, stuffing, abuse, privacy)
