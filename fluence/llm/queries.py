"""The operators' registered queries and, where SQL can express one, its DuckDB equivalent."""

from .chat import OP9_SQL, op9_chat_format
from .decontaminate import op4_decontaminate
from .groupjoin import OP13_SQL, op13_group_jaccard_join
from .licenses import op5_license_scan
from .lm import op2_lm_score
from .mixing import OP3_SQL, op3_mix_to_targets
from .neardup import op1_near_duplicates
from .quality import op10_quality
from .secrets import op8_secret_scan
from .shared import shipped
from .spelling import OP12_SQL, op12_spelling_variants
from .tiff import op6_tiff_media
from .toxicity import op7_toxicity
from .whitening import op11_embedding_whitening

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lm_score": op2_lm_score,
    "op3_mix_to_targets": op3_mix_to_targets,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_tiff_media": op6_tiff_media,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_group_jaccard_join": op13_group_jaccard_join,
}

QUERIES = {name: shipped(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {"op3_mix_to_targets": OP3_SQL, "op9_chat_format": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_group_jaccard_join": OP13_SQL}
