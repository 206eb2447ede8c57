"""The registered queries of this subpackage and their SQL."""

from fairground.llm.decontamination import OP1_SQL, op1_decontamination
from fairground.llm.html_extraction import op3_html_extraction
from fairground.llm.near_dup import OP7_SQL, op7_near_dup
from fairground.llm.periodic_runs import op12_periodic_runs
from fairground.llm.quality_classifier import op6_quality_classifier
from fairground.llm.quality_rules import op10_quality_rules
from fairground.llm.secret_scan import op13_secret_scan
from fairground.llm.sentencepiece import op8_sentencepiece
from fairground.llm.sharding import OP2_SQL, op2_sharding
from fairground.llm.toxicity import op5_toxicity
from fairground.llm.url_filter import OP4_SQL, op4_url_filter
from fairground.llm.warc import OP9_SQL, op9_warc
from fairground.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_sharding,
        op3_html_extraction,
        op4_url_filter,
        op5_toxicity,
        op6_quality_classifier,
        op7_near_dup,
        op8_sentencepiece,
        op9_warc,
        op10_quality_rules,
        op11_embedding_whitening,
        op12_periodic_runs,
        op13_secret_scan,
    )
}
SQL = {
    "op1_decontamination": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op7_near_dup": OP7_SQL,
    "op9_warc": OP9_SQL,
}
