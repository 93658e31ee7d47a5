"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from .audit import OP13_SQL, op13_audit
from .decontamination import OP6_SQL, op6_decontamination
from .embeddings import op2_embeddings
from .language import op3_language
from .mixing import OP4_SQL, op4_mixing
from .pieces import op11_sentencepiece
from .pii import op8_pii
from .quality import op10_quality
from .resampling import OP12_SQL, op12_resampling
from .sharding import op7_sharding
from .urlfilter import OP9_SQL, op9_urlfilter
from .signatures import OP5_SQL, op5_jaccard
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_embeddings": op2_embeddings,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_jaccard": op5_jaccard,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_urlfilter": op9_urlfilter,
    "op10_quality": op10_quality,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_resampling": op12_resampling,
    "op13_audit": op13_audit,
}
ORACLES = {"op1_warc": OP1_SQL, "op4_mixing": OP4_SQL, "op5_jaccard": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_urlfilter": OP9_SQL, "op12_resampling": OP12_SQL, "op13_audit": OP13_SQL}
