import sys

from .shell import main

sys.exit(main(sys.argv[1:]))
