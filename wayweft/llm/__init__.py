"""Optional operators for training data: entity matching, tokens, mixtures and repetition inside documents."""
