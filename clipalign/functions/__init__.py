from clipalign.functions import audio, scalars, vectors

__all__ = ["audio", "scalars", "vectors"]
