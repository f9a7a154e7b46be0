"""Fixed values.

These must equal the original retrieval scripts' values for the same results;
the operators use them as their defaults.
"""

# --- fixed values (do not change) -------------------------------------------
PASSAGE_SIZE = 512            # passage length in tokens (default)
TITLE_TOKEN_CAP = 50          # title tokens kept in front of each token passage
TOKEN_MARGIN = 20             # tokens left free in each token passage
PREPARED_MAX_CHARS = 1000     # characters of title + body in the prepared text
MAX_PASSAGES_PER_DOC = 1024   # passages per document given to a document model
N_NEGATIVES = 50              # rolled negatives per judgement
SAMPLE_QUERIES = 25           # queries of the small development sample
METRICS = ("RR@10", "RR@100", "nDCG@10", "R@1000", "AP@100")
REPORT_DIGITS = 4             # decimals of the metric report
PERCENT_DIGITS = 2            # decimals of the metric report in percent
TOP_K_DOCS = 1000             # documents per query in a document run
TOP_K_PASSAGES = 1000         # passages per query in a passage run
TOP_K_RERANK = 100            # passages per query behind Sum / Mean reranking
TOP_K_LONG_INPUT = 2000       # documents per query for the long-input vectors
HISTOGRAM_BINS = 50           # bins of the passage-position histogram
FIRST_POSITIONS = 10          # positions of the close-up histogram (p < 10, 10 bins)
LOSS_BATCH = 64               # pairs per in-batch loss batch
QUERY_ENCODE_BATCH = 16       # texts per encoder call
# ---------------------------------------------------------------------------
