"""Label consensus, and preparation of training text: packing, mixing and quality statistics."""
