"""The queries of this package, by name: each applies one operator to its whole table."""

from __future__ import annotations

from .bpe import bpe_query
from .exact import EXACT_SQL, exact_query
from .hpy import hpy_query
from .licenses import license_query
from .mixing import mix_query
from .pca import PCA_SQL, pca_query
from .recompress import REPEATS_SQL, repeats_query
from .runs import RUNS_SQL, runs_query
from .secrets import SECRETS_SQL, secrets_query
from .simhash import simhash_query
from .tokens import tokens_query
from .toxicity import toxicity_query
from .whitening import whitening_query

QUERIES = {
    "op1_hpy_score": hpy_query,
    "op2_radix_exact": exact_query,
    "op3_pca_tiles": pca_query,
    "op4_toxicity": toxicity_query,
    "op5_simhash_pigeonhole": simhash_query,
    "op6_entropy_mix": mix_query,
    "op7_license_diagonals": license_query,
    "op8_bpe_tree": bpe_query,
    "op9_token_codes": tokens_query,
    "op10_secret_ledger": secrets_query,
    "op11_exact_whitening": whitening_query,
    "op12_crochemore_runs": runs_query,
    "op13_recompression_cut": repeats_query,
}

ORACLES: dict[str, str] = {
    "op2_radix_exact": EXACT_SQL,
    "op3_pca_tiles": PCA_SQL,
    "op10_secret_ledger": SECRETS_SQL,
    "op12_crochemore_runs": RUNS_SQL,
    "op13_recompression_cut": REPEATS_SQL,
}
