"""Queries of this subpackage and the SQL that states the same, where SQL can."""

from .conversations import op12_conversations
from .decontamination import OP2_SQL, op2_decontamination
from .extraction import op4_extraction
from .jaccard import op11_jaccard
from .language import op6_language
from .licences import op8_licences, op8_sql
from .media import op3_media
from .minhash import op5_minhash
from .mixing import op1_mixing, op1_sql
from .spelling import op13_spelling
from .suffixes import op7_suffix
from .toxicity import op9_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_media": op3_media,
    "op4_extraction": op4_extraction,
    "op5_minhash": op5_minhash,
    "op6_language": op6_language,
    "op7_suffix": op7_suffix,
    "op8_licences": op8_licences,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_jaccard": op11_jaccard,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}
ORACLE = {"op1_mixing": op1_sql(), "op2_decontamination": OP2_SQL, "op8_licences": op8_sql()}
