"""Training-data operators: packing, near and exact dedup, token stores, BPE, classifiers, HTML, top-k, chat."""
