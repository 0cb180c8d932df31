"""Operations for preparing training text, and their queries (``filamenta.llm.queries``)."""
