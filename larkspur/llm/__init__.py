"""Operations on training text: tokenizing, scoring, searching and removing repeats."""
