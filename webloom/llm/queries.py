"""The queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from webloom.llm.decontam import op6_decontam
from webloom.llm.fingerprints import op1_fingerprints
from webloom.llm.htmltext import op9_htmltext
from webloom.llm.langid import op5_langid
from webloom.llm.lm import op3_lm
from webloom.llm.mixing import OP7_SQL, op7_mixing
from webloom.llm.secrets import op4_secrets
from webloom.llm.simhash import op8_simhash
from webloom.llm.substrings import op2_substrings
from webloom.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_substrings, op3_lm, op4_secrets, op5_langid, op6_decontam, op7_mixing, op8_simhash, op9_htmltext, op10_toxicity)
}
SQL = {"op7_mixing": OP7_SQL}
