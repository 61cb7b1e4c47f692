"""Knowledge records, hybrid retrieval and corpus preparation as DataFrame plans."""
