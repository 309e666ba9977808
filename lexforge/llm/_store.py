"""Tables written between steps: the library's own (:mod:`lexforge.scratch`)."""

from lexforge.scratch import discard, materialise, new_folder, shared_root

__all__ = ["discard", "materialise", "new_folder", "shared_root"]
